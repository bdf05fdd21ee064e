import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, warc

TURNS = "conv_id long, turn long, role string, text string"


def brute(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.marked_template(turns)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a]b\\"]), st.text(alphabet="ab\\<>[]/s\n INST\x01é", max_size=20)), max_size=9))
def test_template_round_trip(turns):
    assert chat.read_back(chat.marked_template(turns)) == turns
    whole = lambda t: chat.marked_template(t)  # noqa: E731  makes no promise
    for template in (whole, chat.marked_template, chat.turnwise(2)(lambda t: chat.marked_template(t))):
        spans = list(chat.spans(iter(turns), template))
        text = "".join(s.segment for s in spans)
        assert text == chat.marked_template(turns)
        for span, (_, own) in zip(spans, turns, strict=True):
            assert chat.unescape(text[span.start + span.text_start : span.start + span.text_end]) == own


def test_rewriting_templates_are_noticed():
    counts = lambda turns: f"{len(turns)} turns\n" + chat.marked_template(turns)
    last_only = lambda turns: "".join(t if k == len(turns) - 1 else "..." for k, (_, t) in enumerate(turns))
    numbered = lambda turns: "".join(f"{k}:{t}\n" for k, (_, t) in enumerate(turns))
    for bad in (counts, last_only):
        with pytest.raises(chat.HistoryRewritten):
            list(chat.spans(iter([("user", "a"), ("user", "b")]), bad))
    assert len(list(chat.spans(iter([("user", "a")] * 5), numbered))) == 5
    with pytest.raises(chat.HistoryRewritten):
        list(chat.spans(iter([("user", "a")] * 5), chat.turnwise(1)(lambda t: numbered(t))))


@pytest.mark.parametrize("n", [65, 200, 1000])
def test_verdicts_do_not_depend_on_the_number_of_turns(n):
    """A default block before the first turn is sound at any length; turns dropped beyond 70 are noticed there."""
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(n)]
    opened = lambda t: ("<system>be kind</system>" if t else "") + "".join(f"[{r}]{x}" for r, x in t)
    spans = list(chat.spans(iter(turns), opened))
    assert "".join(s.segment for s in spans) == opened(turns)
    assert [s.segment[s.text_start : s.text_end] for s in spans] == [x for _, x in turns]
    forgetful = lambda t: "".join(f"[{r}]{x}" for r, x in t[-70:])
    if n <= 70:
        assert len(list(chat.spans(iter(turns), forgetful))) == n
    else:
        with pytest.raises(chat.HistoryRewritten):
            list(chat.spans(iter(turns), forgetful))


def test_long_turns():
    long = "x[\\" * 500_000
    (span,) = chat.spans(iter([("assistant", long)]))
    assert chat.unescape(span.segment[span.text_start : span.text_end]) == long


def test_text_before_the_first_turn():
    opened = lambda turns: "<begin>" + chat.marked_template(turns)
    spans = list(chat.spans(iter([("user", "a"), ("assistant", "b")] * 3), chat.turnwise(2)(opened)))
    assert spans[0].segment.startswith("<begin>") and spans[0].start == 0
    text = "".join(s.segment for s in spans)
    assert text == opened([("user", "a"), ("assistant", "b")] * 3)
    assert [text[s.start + s.text_start : s.start + s.text_end] for s in spans] == ["a", "b"] * 3


def test_conversations(spark):
    rows = [(1, 2, "assistant", "x"), (1, 1, "user", None), (2, 1, None, "</s>[INST]"), (None, 1, "user", "n"), (None, None, "assistant", "m"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"t{k}\\[") for k in range(300)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    for name in ("segment", "number", "start"):
        df = df.withColumn(name, df["text"])
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[conv] = brute([(r[2] or "", r[3] or "") for r in own])
    assert {r[0]: tuple(r)[1:] for r in chat.format_digests(df).collect()} == want
    turns = chat.format_turns(df).orderBy("conv_id", "number").collect()
    assert len(turns) == len(rows)
    text = "".join(r["segment"] for r in turns if r["conv_id"] == 4)
    assert "".join(chat.unescape(text[r["loss_start"] : r["loss_end"]]) for r in turns if r["conv_id"] == 4 and r["loss_start"] is not None) == "".join(f"t{k}\\[" for k in range(300) if k % 2)
    assert chat.format_digests(df.limit(0)).count() == 0 == chat.format_turns(df.limit(0)).count()


PAGES = "page_id long, url string, html string"


def test_archives(spark):
    big, other = "<p>" + "x" * 200, "é" * 60
    rows = [(5, "http://a/é", big), (3, None, big), (9, "http://b", big), (7, "u", None), (8, "u", ""), (1, "u", "small"), (2, "u", "small"), (4, "u", other), (6, "v\r\nX: y", other), (6, "u", "line\r\n\r\nWARC/1.1\n"), (None, "u", big), (10, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    for name in ("digest", "payload", "refers_to"):
        df = df.withColumn(name, df["url"])
    path = warc.archive_pages(df, file_bytes=100_000)
    want = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        revisit = len(payload) >= 100 and page != min(same)
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    got = [tuple(r) for r in warc.read_pages(spark, path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert warc.read_pages(spark, warc.archive_pages(df.limit(0))).count() == 0


def test_archives_open_with_the_dictionary_alone(spark):
    import zstandard

    rows = [(k, f"http://h/{k}", f"<html><body>page {k} " + "common words of all pages " * 20) for k in range(300)]
    path = warc.archive_pages(spark.createDataFrame(rows, PAGES))
    (content,) = [bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    size = int.from_bytes(content[4:8], "little")
    dictionary = content[8 : 8 + size]
    assert zstandard.ZstdCompressionDict(dictionary).dict_id() != 0
    records = [warc.parse(r) for r in warc.read_records(content)]
    assert len(records) == 300 and {p for _, _, p in records} == {r[2].encode() for r in rows}
    with pytest.raises(ValueError):
        list(warc.read_records(b"\x00" * 20))


@pytest.mark.parametrize("size", [20_000, 1_000_000])
def test_long_pages_get_a_trained_dictionary(spark, size):
    import random

    import zstandard

    rng = random.Random(size)
    words = [f"<span class='c{k}'>word{rng.randrange(10**6)}</span>" for k in range(300)]
    page = lambda: " ".join(rng.choice(words) for _ in range(size // 25))
    rows = [(k, f"http://h/{k}", page()) for k in range(60 if size < 100_000 else 12)]
    path = warc.archive_pages(spark.createDataFrame(rows, PAGES), file_bytes=5_000_000)
    files = [bytes(r[0]) for r in spark.read.format("binaryFile").load(path).select("content").collect() if len(r[0])]
    dictionary = files[0][8 : 8 + int.from_bytes(files[0][4:8], "little")]
    assert len(dictionary) > 1000 and zstandard.ZstdCompressionDict(dictionary).dict_id() != 0
    assert size < 100_000 or len(files) > 1  # archives are cut by bytes
    assert {warc.parse(r)[2] for f in files for r in warc.read_records(f)} == {r[2].encode() for r in rows}


def test_revisits_of_a_common_page(spark):
    rows = [(k, "u", "error page " * 20 if k % 10 else f"page {k} " * 20) for k in range(1000)] + [(None, f"u{k}", "error page " * 20) for k in range(500)]
    found = warc.revisits(warc.with_payload(spark.createDataFrame(rows, PAGES)).select("page_id", "digest", "size"))
    assert sorted(r["page_id"] or 0 for r in found.collect()) == [0] + [k for k in range(2, 1000) if k % 10]
    assert {r[0] for r in found.select("refers_to").distinct().collect()} == {1}
    read = warc.read_pages(spark, warc.archive_pages(spark.createDataFrame(rows, PAGES)))
    assert read.count() == 1500 and read.where("record_type = 'response'").count() == 101


def test_dictionary_of_few_samples():
    assert warc.build_dictionary([]) == b""
    assert warc.build_dictionary([b"one"]) == b"one"
