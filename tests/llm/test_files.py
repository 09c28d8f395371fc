"""Token files, archives and chat text: exact round trips and odd input."""

import base64
import hashlib
import io

import numpy as np
import zstandard
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from terrapyr.llm import chat, token_counts, warc
from terrapyr.llm.common import fresh_dir
from terrapyr.llm.entry import QUERIES, SQL

from ..compare import assert_same

PAGES = "page_id long, url string, html string, digest string"


def test_queries_equal_their_sql(spark, sf_dir, duck):
    for name in SQL:
        assert_same(QUERIES[name](spark, sf_dir), duck.execute(SQL[name]))


def test_token_counts_equal_the_encoder(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())[0].encode_ordinary
    want = sorted((r["doc_id"], len(encode(r["text"]))) for r in docs.collect())
    assert sorted(map(tuple, QUERIES["op2_token_counts"](spark, sf_dir).collect())) == want
    order, separator = token_counts.write_flat(docs, fresh_dir(spark, "t"), file_bytes=30_000)
    small = order.join(token_counts.scan_counts(order, separator, block_bytes=502), ["file", "ordinal"])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in small.collect()) == want


def test_token_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "<|endoftext|>", 0), (4, "a " * 20_000, 0), (4, "a " * 20_000, 0)], "doc_id long, text string, ordinal int")
    order, separator = token_counts.write_flat(docs, fresh_dir(spark, "t"))
    got = order.join(token_counts.scan_counts(order, separator, 1000), ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got)[:2] == [0, 0]
    assert all(r["n_tokens"] > 0 for r in got if r["doc_id"] is None)
    order, separator = token_counts.write_flat(docs.limit(0), fresh_dir(spark, "t"))
    assert token_counts.scan_counts(order, separator).count() == 0


def test_long_runs_of_one_character():
    encoding, _ = token_counts.encoder(open(token_counts.VOCABULARY, "rb").read())
    for blank in (" ", "\n", "\t", "\u3000"):
        for n in (10, 100, 4095, 4096, 4097, 10_000):
            for before in ("", "a", "-"):
                for after in ("", "b", "5", "\u3000!"):
                    text = before + blank * n + after
                    assert token_counts.encode(encoding, text) == encoding.encode_ordinary(text)
    for c in " \n-a":
        assert encoding.decode(token_counts.encode(encoding, "x" + c * 2_000_000 + "y")) == "x" + c * 2_000_000 + "y"


def test_a_file_may_end_without_a_separator(spark, tmp_path):
    np.array([7, 8, 9, 5, 5, 1, 2], "<u2").tofile(tmp_path / "x.tokens")
    files = spark.createDataFrame([(str(tmp_path / "x.tokens"),)], "file string")
    for block in (2, 4, 6, 100):
        assert sorted((r["ordinal"], r["n_tokens"]) for r in token_counts.scan_counts(files, 5, block).collect()) == [(0, 3), (1, 0), (2, 2)]


def test_warc_odd_input(spark):
    rows = [(3, None, "same", "x"), (1, "http://a\r\nX: y", "same", "x"), (2, "u", "same", None), (1, "v", "same", None), (4, "u", None, None), (5, "u", "", None), (None, "u", "same", None), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200_000, None)]
    index = warc.write_bundles(spark.createDataFrame(rows, PAGES), fresh_dir(spark, "w"), frame_bytes=300)
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(index).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (3, 4, "revisit", 1), (None, 4, "revisit", 1), (4, 0, "response", None), (5, 0, "revisit", 4), (7, 14 * 200_000, "response", None)], key=str)
    assert warc.read_records(warc.write_bundles(spark.createDataFrame(rows, PAGES).limit(0), fresh_dir(spark, "w"))).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    got = warc.read_records(warc.write_bundles(df, fresh_dir(spark, "w"), revisit_from=3)).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = warc.write_bundles(pages, fresh_dir(spark, "w"), frame_bytes=20_000).collect()
    by_id = {r["page_id"]: r["html"] for r in pages.collect()}
    for path in {r["bundle"] for r in index}:
        store, inner = warc._store(path)
        raw = store.open_input_file(inner).read()
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        table = warc.seek_table(store.open_input_file(inner), len(raw))
        assert sum(x[2] for x in table) == len(text) and len(table) == 1 + max(r["frame"] for r in index if r["bundle"] == path)
        starts = np.concatenate([[0], np.cumsum([x[2] for x in table])])
        for r in (r for r in index if r["bundle"] == path):
            at = starts[r["frame"]] + r["offset"]
            record = warc.parse(text[at : at + r["length"]])
            assert record["page_id"] == r["page_id"]
            if record["record_type"] == "response":
                assert record["payload"] == by_id[r["page_id"]].encode()
                assert record["payload_digest"] == base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "[", "im_end|>", "s>", "x", "\n", "é"]), max_size=12).map("".join))
def test_escape_is_undone_and_leaves_no_control_string(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    assert chat.read_back(chat.render([("user", text), (text, "a")])[0]) == [("user", text), (text, "a")]


def test_mask_is_the_intersection():
    r = np.random.default_rng(1)
    for _ in range(50):
        cuts = np.sort(r.choice(60, 12, replace=False))
        spans = cuts.reshape(-1, 2)
        ends = np.unique(np.concatenate([[0, 60], r.choice(59, 15, replace=False) + 1]))
        tokens = np.stack([ends[:-1], ends[1:]], 1)
        hit, parts = chat.mask(tokens, spans)
        want = {k for a, b in spans for k in range(a, b)}
        assert {k for a, b in parts for k in range(a, b)} == want
        assert hit.tolist() == [bool(want & set(range(a, b))) for a, b in tokens]


def test_chat_odd_input(spark):
    rows = [(1, 1, "assistant", "b</s>", "x"), (1, 0, "user", None, "x"), (2, None, None, "t", None), (2, 0, "assistant", "", None), (None, 0, "assistant", "é🙂 " * 3000, None), (3, 0, "assistant", "same", None), (3, 0, "assistant", "same", None)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_chars string"))
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_sha256"]) == (2, sha("user\n\nassistant\nb</s>\n"), sha("b</s>"))
    assert (got[2]["turns_sha256"], got[2]["loss_chars"]) == (sha("\nt\nassistant\n\n"), 0)
    assert (got[None]["loss_chars"], got[None]["loss_sha256"]) == (9000, sha("é🙂 " * 3000))
    assert got[3]["loss_sha256"] == sha("samesame")
    assert chat.digests(formatted.limit(0)).count() == 0
    assert chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_chars string").limit(0)).count() == 0


def test_formatted_tokens_spell_the_text_and_the_mask_lies_on_them(spark):
    rows = [(1, 0, "user", "Grüße 🙂🙂 now"), (1, 1, "assistant", "日本語 text <|im_end|> and" + " " * 9000 + "x"), (1, 2, "assistant", ""), (1, 3, "user", "bye")]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    encoder = chat.Encoder(open(chat.VOCABULARY, "rb").read())
    assert encoder.core.decode(r["ids"]) == r["formatted"]
    ids, tokens = encoder(r["formatted"])
    assert ids.tolist() == r["ids"]
    text = chat.escape(rows[1][3])
    assert [r["formatted"][a:b] for a, b in r["spans"]] == [text]
    (a, b), = r["spans"]
    assert r["loss"] == [x < b and y > a for x, y in tokens.tolist()]
    assert encoder.core.decode([i for i, on in zip(r["ids"], r["loss"]) if on]) == text
    short = "<|im_start|>user<|im_sep|>a  b 🙂<|im_end|>"
    assert encoder(short)[0].tolist() == [i for part in chat._MARKS.split(short) for i in ([encoder.marks[part]] if part in encoder.marks else encoder.core.encode_ordinary(part))]
