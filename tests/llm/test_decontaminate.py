"""Decontamination against containment, and against templates matched slowly, word by word."""

import random
import re

import pytest
from pyspark.sql import functions as F

from terrapyr.llm import decontaminate
from terrapyr.llm.entry import QUERIES

FOLD = {c: c + 32 for c in [*range(65, 91), *range(0xC0, 0xDF), *range(0x391, 0x3AA), *range(0x410, 0x430)] if c != 0xD7}
STOPS, BREAKS = set(".!?\n:"), set(".,;!?\n:()")


def plain_words(text):
    """(lower-case word, kind, name, begins a line) of every word; kind: number, unit or nothing."""
    units, openers = set(decontaminate.UNITS.split()), set(decontaminate.OPENERS.split())
    found = []
    for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", text or ""):
        if found and m[0][0] in "0123456789" and found[-1][2][0] in "0123456789" and m.start() == found[-1][1] + 1 and text[m.start() - 1] in ".,":
            found[-1] = (found[-1][0], m.end(), text[found[-1][0] : m.end()])
        else:
            found.append((m.start(), m.end(), m[0]))
    out = []
    for i, (a, _, w) in enumerate(found):
        gap = text[found[i - 1][1] : a] if i else "\n"
        low, digit = w.translate(FOLD), w[0] in "0123456789"
        kind = "number" if digit else "unit" if i and found[i - 1][2][0] in "0123456789" and low in units else ""
        name = ord(w[0]) in FOLD and (not STOPS & set(gap) or low not in openers)
        out.append({"w": low, "kind": kind, "name": name, "joined": name and i > 0 and out[-1]["name"] and not BREAKS & set(gap), "line": "\n" in gap})
    return out


def plain_windows(ws):
    """{template: [(position, length, form, what is said, slots)]} and the positions that templates reach."""
    out, reach = [], set()
    for i in range(len(ws) - 4):
        five = ws[i : i + 5]
        slots = tuple(x["w"] if x["kind"] else None for x in five)
        if sum(s is None for s in slots) >= 2:
            out.append((("slots", *(x["kind"] and f"<{x['kind']}>" or x["w"] for x in five)), i, 5, "slots", tuple(x["w"] for x in five), slots))
            reach |= set(range(i, i + 5))
        else:
            out.append((("words", *(x["w"] for x in five)), i, 5, "words", tuple(x["w"] for x in five), ()))
    tokens = []
    for i, x in enumerate(ws):
        if x["joined"]:
            tokens[-1][1].append(x)
        else:
            tokens.append((i, [x]))
    for k in range(len(tokens) - 4):
        five = tokens[k : k + 5]
        slots = tuple(" ".join(x["w"] for x in t) if t[0]["name"] or t[0]["kind"] else None for _, t in five)
        if sum(s is None for s in slots) >= 2 and any(t[0]["name"] for _, t in five):
            end = five[-1][0] + len(five[-1][1])
            said = tuple(x["w"] for x in ws[five[0][0] : end])
            out.append((("names", *("<name>" if t[0]["name"] else f"<{t[0]['kind']}>" if t[0]["kind"] else t[0]["w"] for _, t in five)), five[0][0], end - five[0][0], "names", said, slots))
            reach |= set(range(five[0][0], end))
    starts = [i for i, x in enumerate(ws) if x["line"]] + [len(ws)]
    for a, b in zip(starts, starts[1:]):
        if b - a < 5:
            out.append((("line", *(x["w"] for x in ws[a:b])), a, b - a, "line", (), ()))
    return out, reach


def steady(matches):
    there, back = {}, {}
    for _, _, _, _, _, pairs in matches:
        for i, d in pairs:
            if there.setdefault(i, d) != d or back.setdefault(d, i) != i:
                return False
    return True


def plainly_contaminated(doc, item):
    iw, dw = plain_words(item), plain_words(doc)
    mine, reach = plain_windows(iw)
    theirs, _ = plain_windows(dw)
    by = {}
    for t, pos, _, form, said, slots in theirs:
        by.setdefault(t, []).append((pos, said, slots))
    met = []
    for t, at, span, form, said, slots in mine:
        if form == "line" and not (len(iw) < 5 and span == len(iw)):
            continue
        for pos, other, found in by.get(t, ()):
            if form == "line":
                return True
            met.append((pos - at, at, span, form, said == other, [(a, b) for a, b in zip(slots, found) if a is not None]))
    kept = []
    for far in {m[0] for m in met}:
        line = [m for m in met if m[0] == far]
        at = {m[1] for m in line}
        for first in (a for a in at if a - 1 not in at):
            last = first
            while last + 1 in at:
                last += 1
            group = [m for m in line if first <= m[1] <= last]
            if not steady(group):
                group = [m for m in group if m[4]]
            have = {m[1] for m in group}
            if any(all(a + k in have for k in range(9)) for a in have):
                return True
            kept += group
    for far in {m[0] for m in kept}:
        band = [m for m in kept if far <= m[0] <= far + 8]
        if not steady(band):
            band = [m for m in band if m[4]]
        cover = {w for m in band for w in range(m[1], m[1] + m[2])}
        held = {w for m in band if m[3] != "words" for w in range(m[1], m[1] + m[2])}
        if len(cover) >= 0.8 * len(iw) or (len(reach) >= 0.75 * len(iw) and len(held) >= 0.8 * len(reach)):
            return True
    return False


def test_query_against_templates_by_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {r["doc_id"]: sorted(b["item_id"] for b in bench if plainly_contaminated(r["text"], b["text"])) for r in docs}
    assert {r["doc_id"]: r["item_ids"] for r in QUERIES["op4_decontaminate"](spark, sf_dir).collect()} == want


def test_random_questions_against_templates_by_brute_force(spark):
    """Questions with other numbers, names and units, words put in, left out and swapped, on both sides of the limits."""
    r = random.Random(6)
    names, units = ["Anna", "Bob", "Mary Ann", "Łukasz", "Ägidius", "Ирина"], ["kg", "oz", "miles", "l"]
    frames = ["{a} has {x} red apples. {a} buys {y} {u} more apples and {b} eats {x}. How many does {a} have?", "What is {x} plus {y} minus {x} times {z} over {y}", "If {b} walks {x} {u} a day and {a} walks {y} {u}, who is ahead after {z} days of walking with {b}?", "Compute {x} {y} {z} {x} and {y} then give the sum", "{a} met {b} in the old town\nshort line here\nand {x} people saw them go home together at night"]
    fill = lambda f: f.format(a=r.choice(names), b=r.choice(names), u=r.choice(units), x=r.randrange(2, 90), y=f"{r.randrange(2, 9)}.{r.randrange(10, 99)}", z=r.randrange(2, 9))
    items = [fill(f) for f in frames] + ["short line here", "Two words", "one", ""]
    docs = []
    for i in range(160):
        w = fill(r.choice(frames)).split(" ")
        for _ in range(r.randrange(0, 4)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(0, 2)] = r.choice([["zebra"], [], [str(r.randrange(9))], ["Zoe"], w[k : k + 1] * 2])
            w = w or ["x"]
        docs.append(r.choice(["", "Before this. ", "one\n"]) + " ".join(w) + r.choice(["", " And so on.", "\ntwo words\n"]))
    want = {i: [k for k, t in enumerate(items) if plainly_contaminated(d, t)] for i, d in enumerate(docs)}
    assert 20 < sum(map(bool, want.values())) < 160
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for held in (2_000_000, 0):
        got = {x["_id"]: x["items"] for x in decontaminate.find(df, bench, held_windows=held).collect()}
        assert {i: got.get(i, []) for i in want} == want


@pytest.mark.parametrize("doc, item", [
    ("What is 1 plus 8 minus 4 times 6 over 5", "What is 12 plus 7 minus 3 times 9 over 2"),
    ("Compute 3 4 5 6 and 7 8 9 then give the sum", "Compute 3 4 5 6 and 7 8 9 then give the sum"),
    ("Bob has 5 apples. Bob buys 2 kg more. How many has Bob?", "Anna has 3 apples. Anna buys 4 kg more. How many has Anna?"),
    ("Mary Ann has 8 red apples. Mary Ann buys 9 more apples. How many does Mary Ann have?", "Tom has 3 red apples. Tom buys 4 more apples. How many does Tom have?"),
    ("x\nTWO  words!\ny", "two words"),
])
def test_questions_that_must_be_found(spark, doc, item):
    found = decontaminate.find(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [r["items"] for r in found] == [[9]] and plainly_contaminated(doc, item)


def test_a_word_put_in_or_left_out_hides_nothing(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = []
    for r in bench.collect():
        w = r["text"].split()
        rows += [(r["item_id"], " ".join([*w[: len(w) // 2], "zebra", *w[len(w) // 2 :]])), (r["item_id"], " ".join([*w[: len(w) // 2], *w[len(w) // 2 + 1 :]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find(df, bench).collect()
    assert len(found) == len(rows) and all(r["_id"] in r["items"] for r in found)


def test_contamination_query_against_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [(r["item_id"], norm(r["text"])) for r in bench.collect()]
    want = {r["doc_id"]: sorted(i for i, x in items if f" {x} " in f" {norm(r['text'])} ") for r in docs.collect()}
    got = {r["doc_id"]: r["item_ids"] for r in QUERIES["op4_decontaminate"](spark, sf_dir).collect()}
    assert got == want and any(want.values())


def test_slots_must_be_consistent(spark):
    q = "If Alice has 12 apples and gives 5 kg to Bob then how many apples does Alice have after 12 days of work"
    bench = spark.createDataFrame([(1, q), (2, None), (3, "two words")], "item_id long, text string")
    rows = [
        (1, "Intro. " + q.replace("Alice", "Carol").replace("12", "7").replace("kg", "km") + " Outro."),
        (2, q.replace("Alice", "Carol").replace("after 12", "after 9").replace("gives 5 kg", "gives 6 lb")),
        (3, None),
        (4, ""),
        (None, q.lower()),
        (6, q.upper()),
        (7, "two words"),
        (8, "filler " * 30_000 + q),
        (8, "filler " * 30_000 + q),
        (9, q.replace("12", "1,200.50")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_h", F.lit("clash")).withColumn("hash", F.lit(1))
    want = {1, None, 6, 7, 8, 9}
    for held in (2_000_000, 0):
        assert {r["_id"] for r in decontaminate.find(docs, bench, held_windows=held).collect()} == want
    kept = decontaminate.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.clean(docs.limit(0), bench).count() == 0


def test_items_rich_in_numbers_are_found_verbatim(spark):
    items = ["Evaluate 12 + 7 * 3 - 45 / 9 + 100 - 8.", "Add 3 kg, 250 g, 2 kg and 750 g."]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(0, f"Some words before. {items[0]} Some after."), (1, items[1]), (2, "Evaluate 13 + 6 * 2 - 44 / 8 + 101 - 7."), (3, "Add 4 kg, 150 g, 1 kg and 50 g.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for held in (2_000_000, 0):
        got = {r["_id"]: (r["items"], r["coverage"]) for r in decontaminate.find(docs, bench, held_windows=held).collect()}
        assert got == {0: ([0], 1.0), 1: ([1], 1.0)}
