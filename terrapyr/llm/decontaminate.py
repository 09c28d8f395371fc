"""Operator 4, benchmark decontamination by template canonicalisation.

Words are runs of letters, digits and non-ASCII bytes, in lower case; numbers with inner
points or commas are one word. In a template a number is `<number>`, a unit after a number
`<unit>`; in its second form a capitalised word is `<name>` too, and so is a run of them with
nothing but blanks between. A word that opens a sentence counts as a name unless it is on a
list of words that commonly do. Windows of five template words are hashed if at least two
of them are plain; the others match word by word. Items of fewer than five words match lines
that have just their words. Documents' windows meet the benchmark's in an equi-join on the
hash, and every pair of a document and an item that share enough is then aligned:

* matches whose distance (document position minus item position) is equal and that follow
  each other in the item are a run. A run keeps all its windows if its slots are consistent:
  what replaces one number, unit or name of the item is one and the same throughout, and two
  of them never become one. Otherwise it keeps the windows that agree word by word.
* a run of `run` windows (nine are thirteen words in a row) contaminates the document;
* so do windows of distances within `shift` of each other (words may be put in or left out)
  that cover `coverage` of the item's words or, where three quarters of its words lie in
  windows with two plain ones, of these. Here too, inconsistent slots leave what agrees word
  by word.

So a question with other numbers, names or units is found, and one that only shares a frame
is not. Null and empty texts have no words: such documents are clean and such items
contaminate nothing, like those of an empty benchmark; an empty table of documents gives an
empty one. Very long texts are worked on half a MB or one text at a time; an alignment
holds the matches of one document and one item. Rows are told apart by id and text: repeated
rows get the same verdict, whatever their number. Ties do not arise: all items that are
found are named, in order. Other columns may have any names.

Documents are not shuffled: workers hold the benchmark's window hashes, if there are at most
`held_windows`, and send on only windows whose hash is among them; beyond that number all
windows go to the join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ODD, HELD_ROWS, Spans, arrow_bytes, fold_letters, mix, settle, slices, table, words

WINDOW = 5
PLAIN = 2
#: Unit words.
UNITS = "mm cm m km inch inches foot feet ft yard yards yd mile miles mg g kg ton tons ounce ounces oz pound pounds lb lbs ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degree degrees dollar dollars euro euros cent cents mph kmh hz khz mhz ghz w kw kwh v volt volts a amp amps n newton newtons j joule joules pa bar"
#: Words that open sentences without being names.
OPENERS = "a about after again all also although an and another any are as at because before both but by can compute could did do does each either every evaluate even few find first for from give given had has have he her here his how however i if in into is it its let many may more most my no not now of on once one only or other our out over she should show simplify since so solve some such suppose than that the their then there these they this those though thus to two under until up was we were what when where whether which while who whose why will with without would write you your"
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA11CE5, 0xB0B5, 0xC0FFEE))
#: Forms of windows: numbers and units as slots, names too, word by word, a whole line.
SLOTS, NAMED, VERBATIM, LINE = range(4)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, _ = words(data, np.array([0, len(data)]))
    return np.sort(Spans(data).hash(start, end))


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted array."""
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h if len(known) else np.zeros(len(h), bool)


_UNITS, _OPENERS = _hashes(UNITS), _hashes(OPENERS)


def _chain(values: np.ndarray, at: np.ndarray, many: int = WINDOW) -> np.ndarray:
    """A hash of `many` values from each position on."""
    total, power = np.zeros(len(at), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(many):
            power = power * _ODD
            total += values[at + k] * power
    return total


class Windows:
    """The windows of some texts: arrays of one entry a window, and slots for those that are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        docs = len(offsets) - 1
        start, end, doc = words(data, offsets)
        self.count = self.reach = np.bincount(doc, minlength=docs)
        self.doc = self.pos = self.span = self.form = np.zeros(0, np.int64)
        self.hash = self.exact = np.zeros(0, np.uint64)
        if not len(start):
            return
        first = data[start]
        number = (first >= 48) & (first <= 57)
        joined = np.zeros(len(start), bool)
        joined[1:] = number[1:] & number[:-1] & (doc[1:] == doc[:-1]) & (start[1:] - end[:-1] == 1) & np.isin(data[np.minimum(end[:-1], len(data) - 1)], np.frombuffer(b".,", np.uint8))
        lead = np.flatnonzero(~joined)
        end = end[np.concatenate([lead[1:], [len(start)]]) - 1]
        start, doc, number, first = start[lead], doc[lead], number[lead], first[lead]
        n = len(start)
        self.count = np.bincount(doc, minlength=docs)
        h = Spans(fold_letters(data)).hash(start, end)
        follows = np.zeros(n, bool)
        follows[1:] = doc[1:] == doc[:-1]
        unit = np.zeros(n, bool)
        after = np.flatnonzero(follows[1:] & number[:-1]) + 1
        unit[after] = _member(h[after], _UNITS) & ~number[after]

        def unbroken(marks: bytes) -> np.ndarray:
            """Whether a word follows another without one of these bytes between."""
            seen = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(marks, np.uint8)))])
            out = follows.copy()
            out[1:] &= seen[start[1:]] == seen[end[:-1]]
            return out

        second = data[np.minimum(start + 1, len(data) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)) | ((first == 0xCE) & (second >= 0x91) & (second <= 0xA9)) | ((first == 0xD0) & (second >= 0x90) & (second <= 0xAF))
        name = capital & (unbroken(b".!?\n:") | ~_member(h, _OPENERS))
        base = np.cumsum(self.count) - self.count
        position = np.arange(n) - base[doc]
        same = doc[: 1 - WINDOW] == doc[WINDOW - 1 :] if n >= WINDOW else np.zeros(0, bool)
        whole = np.flatnonzero(same)
        slot = number | unit
        plain = np.concatenate([[0], np.cumsum(~slot)])
        exact = np.zeros(n, np.uint64)
        exact[whole] = mix(_chain(h, whole))
        template = np.where(number, NUMBER, np.where(unit, UNIT, h))
        enough = plain[whole + WINDOW] - plain[whole] >= PLAIN if len(whole) else np.zeros(0, bool)
        at, rest = whole[enough], whole[~enough]
        parts = [(SLOTS, doc[at], position[at], np.full(len(at), WINDOW), mix(_chain(template, at)), exact[at], at)]
        parts.append((VERBATIM, doc[rest], position[rest], np.full(len(rest), WINDOW), mix(_chain(h, rest) + np.uint64(VERBATIM)), exact[rest], rest))

        # Names: runs of them are one template word.
        merged = name & unbroken(b".,;!?\n:()")
        merged[1:] &= name[:-1]
        merged[:1] = False
        token = np.flatnonzero(~merged)
        past = np.concatenate([token[1:], [n]])
        with np.errstate(over="ignore"):
            rank = np.arange(n) - np.repeat(token, past - token)
            run = np.add.reduceat(mix(h + rank.astype(np.uint64)), token)
        self._token_hash = np.where(past - token > 1, run, h[token])
        tname, tslot, tdoc = name[token], slot[token], doc[token]
        ttemplate = np.where(tname, NAME, template[token])
        tplain = np.concatenate([[0], np.cumsum(~(tname | tslot))])
        tnames = np.concatenate([[0], np.cumsum(tname)])
        at = np.flatnonzero(tdoc[: 1 - WINDOW] == tdoc[WINDOW - 1 :]) if len(token) >= WINDOW else np.zeros(0, np.int64)
        at = at[(tplain[at + WINDOW] - tplain[at] >= PLAIN) & (tnames[at + WINDOW] > tnames[at])]
        ends = past[at + WINDOW - 1]
        with np.errstate(over="ignore"):
            said = mix(_chain(self._token_hash, at) + (ends - token[at]).astype(np.uint64))
        parts.append((NAMED, tdoc[at], position[token[at]], ends - token[at], mix(_chain(ttemplate, at) + np.uint64(NAMED)), said, at))

        # Short lines, whole.
        new = ~unbroken(b"\n")
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate([at, [n]]))
        at, size = at[size < WINDOW], size[size < WINDOW]
        total = np.zeros(len(at), np.uint64)
        for many in range(1, WINDOW):
            total[size == many] = _chain(h, at[size == many], many)
        with np.errstate(over="ignore"):
            total = mix(total + np.uint64(LINE) + size.astype(np.uint64) * np.uint64(16))
        parts.append((LINE, doc[at], position[at], size, total, total, at))

        self.form = np.repeat([x[0] for x in parts], [len(x[1]) for x in parts])
        self.doc, self.pos, self.span, self.hash, self.exact, self._at = (np.concatenate([x[i] for x in parts]) for i in range(1, 7))
        self._h, self._slot, self._tslot = h, slot, tname | tslot
        # Words in a window that stands as a template.
        cover = np.zeros(n + 1, np.int64)
        for k in (0, 2):
            a = base[parts[k][1]] + parts[k][2]
            np.add.at(cover, a, 1)
            np.add.at(cover, a + parts[k][3], -1)
        self.reach = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=docs)

    def slots(self, rows: np.ndarray) -> np.ndarray:
        """Hashes of what the placeholders of each window replace, zero for plain words."""
        if not len(rows):
            return np.zeros((0, WINDOW), np.int64)
        out = np.zeros((len(rows), WINDOW), np.int64)
        for form, slot, h in ((SLOTS, self._slot, self._h), (NAMED, self._tslot, self._token_hash)):
            mine = np.flatnonzero(self.form[rows] == form)
            cells = self._at[rows[mine]][:, None] + np.arange(WINDOW)
            out[mine] = np.where(slot[cells], h[cells].view(np.int64) | 1, 0)
        return out


def _windows(texts: DataFrame, keys: list[str], held: np.ndarray | None) -> DataFrame:
    """(keys, n_words, reach, form, pos, span, hash, exact, slots) of the windows of `text`; held: sorted hashes to keep, None for all."""
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    gate = None
    if held is not None:
        gate = np.zeros(1 << 22, bool)
        gate[held >> np.uint64(42)] = True

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 0.5):
                w = Windows(*arrow_bytes(part.column("text")))
                rows = np.arange(len(w.hash))
                if gate is not None:
                    rows = np.flatnonzero(gate[w.hash >> np.uint64(42)])
                    rows = rows[_member(w.hash[rows], held)]
                cells = w.slots(rows)
                some = cells.any(1)
                ends = np.concatenate([[0], np.cumsum(some * WINDOW)]).astype(np.int32)
                doc = w.doc[rows]
                long = lambda v: pa.array(v, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(doc)) for k in keys], long(w.count[doc]), long(w.reach[doc]), long(w.form[rows]), long(w.pos[rows]), long(w.span[rows]), long(w.hash[rows].view(np.int64)), long(w.exact[rows].view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), long(cells[some].ravel()))], [*keys, "n_words", "reach", "form", "pos", "span", "hash", "exact", "slots"])

    return texts.select(*keys, "text").mapInArrow(work, f"{kinds}, n_words long, reach long, form long, pos long, span long, hash long, exact long, slots array<long>")


def _one_to_one(pairs: set) -> bool:
    return len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})


def align(matches: list[tuple], n_words: int, reach: int, run: int, shift: int) -> tuple[bool, float]:
    """matches: (pos, item_pos, span, form, verbatim, pairs of slots). Whether there is a long run, and the best coverage."""
    lines: dict = {}
    for pos, at, span, form, same, pairs in matches:
        if form == LINE:
            return True, 1.0
        lines.setdefault(pos - at, {}).setdefault(at, []).append((span, form, same, pairs))
    kept, long = [], False
    for far, cells in lines.items():
        ats = sorted(cells)
        for group in np.split(np.array(ats), np.flatnonzero(np.diff(ats) > 1) + 1):
            every = [(far, at, *m) for at in group.tolist() for m in cells[at]]
            if not _one_to_one({p for m in every for p in m[5]}):
                every = [m for m in every if m[4]]
            kept += every
            held = sorted({m[1] for m in every})
            begin = 0
            for i in range(len(held)):
                if i and held[i] != held[i - 1] + 1:
                    begin = i
                long |= i - begin + 1 >= run
    kept.sort()
    far, best, past = [m[0] for m in kept], 0.0, 0
    for i in range(len(kept)):
        if i and far[i] == far[i - 1]:
            continue
        past = max(past, i)
        while past < len(kept) and far[past] <= far[i] + shift:
            past += 1
        band = kept[i:past]
        if not _one_to_one({p for m in band for p in m[5]}):
            band = [m for m in band if m[4]]
        every, template = np.zeros(n_words + 1, np.int64), np.zeros(n_words + 1, np.int64)
        for _, at, span, form, _, _ in band:
            for cover in (every, template) if form != VERBATIM else (every,):
                cover[at] += 1
                cover[min(at + span, n_words)] -= 1
        best = max(best, (np.cumsum(every)[:-1] > 0).sum() / n_words)
        if 4 * reach >= 3 * n_words:
            best = max(best, (np.cumsum(template)[:-1] > 0).sum() / reach)
    return bool(long), float(best)


def find(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, run: int = 9, shift: int = 8, held_windows: int = 2_000_000) -> DataFrame:
    """(_id, _h, items, coverage) of contaminated documents. _h: hash of the text."""
    items = _windows(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ["item_id"], None)
    # A line of an item is no item, unless it is all of it.
    items = items.where((F.col("form") != LINE) | ((F.col("n_words") < WINDOW) & (F.col("span") == F.col("n_words"))))
    items = items.select("item_id", F.col("pos").alias("item_pos"), "form", "span", "hash", F.col("exact").alias("item_exact"), F.col("slots").alias("item_slots"), "n_words", "reach")
    n = items.count()
    held = None
    if n <= held_windows:
        held = np.unique(np.array([r[0] for r in items.select("hash").distinct().collect()], np.int64).view(np.uint64))
    hits = _windows(keyed(docs), ["_id", "_h"], held).select("_id", "_h", "pos", "hash", "exact", "slots")
    met = hits.join(F.broadcast(items) if n <= 50_000 else items, "hash")
    match = F.struct("pos", "item_pos", "span", "form", (F.col("exact") == F.col("item_exact")).alias("same"), "item_slots", "slots").alias("m")
    groups = met.groupBy("_id", "_h", "item_id").agg(F.first("n_words").alias("n_words"), F.first("reach").alias("reach"), F.sum("span").alias("spans"), F.count("*").alias("n"), F.collect_list(match).alias("matches"))
    # What cannot be enough is not aligned.
    groups = groups.where((F.col("spans") >= coverage * F.least("n_words", F.greatest("reach", F.lit(1)))) | (F.col("n") >= run))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            keep, share = [], []
            for k, (n_words, reach, found) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("reach").to_pylist(), batch.column("matches"))):
                matches = []
                for m in found.as_py():
                    pairs = [(i, d) for i, d in zip(m["item_slots"], m["slots"]) if i] if m["item_slots"] and m["slots"] else []
                    matches.append((m["pos"], m["item_pos"], m["span"], m["form"], m["same"], tuple(pairs)))
                long, best = align(matches, n_words, reach, run, shift)
                if long or best >= coverage:
                    keep.append(k)
                    share.append(best)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in ("_id", "_h", "item_id")], pa.array(share, pa.float64())], ["_id", "_h", "item_id", "coverage"])

    found = groups.select("_id", "_h", "item_id", "n_words", "reach", "matches").mapInArrow(judge, f"_id {kind}, _h long, item_id long, coverage double")
    return found.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without contaminated ones, in their own columns."""
    bad = settle(find(docs, benchmark, **options).select("_id", "_h"), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= HELD_ROWS else bad
    same_text = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == bad["_h"]
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & same_text, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = find(docs, table(spark, sf_dir, "benchmark"))
    out = keyed(docs).drop("text").withColumnsRenamed({"_id": "doc_id", "_h": "h"}).join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
