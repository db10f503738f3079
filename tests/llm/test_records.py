"""Archives, chats and toxicity: exact round trips and held-out accuracy."""

import gzip
import hashlib
import os
import random
import zlib

import pytest

from axisframe.llm import chat_format, toxicity, warc

PAGES = "page_id long, url string, html string"


def expected_pages(rows):
    first = {}
    for page_id, _, html in rows:
        key = (html or "").encode()
        if page_id is not None:
            first[key] = min(first.get(key, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and first.get(data) != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first.get(data) if again else None))
    return sorted(out, key=str)


def test_pages_through_archives(spark):
    rows = [(i, f"http://host/{i % 7}", "<p>é</p>" * (i % 40)) for i in range(120)]
    rows += [(900, "http://a b\nc", None), (901, None, "x"), (None, "http://n", None), (902, "u", "y" * 200), (903, "u", "y" * 200), (5, "dup", "y" * 200), (None, "q", "y" * 200), (904, "z", "short"), (905, "z", "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows], PAGES + ", head int")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.report(df).collect()]
    assert sorted(got, key=str) == expected_pages(rows)
    assert warc.report(df.limit(0)).count() == 0


def test_repeated_rows_give_one_response(spark):
    df = spark.createDataFrame([(1, "u", "y" * 200)] * 3, PAGES)
    found = warc.report(df).collect()
    assert sorted(r["record_type"] for r in found) == ["response", "revisit", "revisit"] and {r["refers_to"] for r in found} == {None, 1}


def arc(version: int, records: list[tuple[str, bytes]]) -> bytes:
    block = f"{version} 0 test\n{warc.HEADINGS[version]}\n".encode()
    out = f"filedesc://a.arc 0.0.0.0 20240102 text/plain {'200 - - 0 a.arc ' if version == 2 else ''}{len(block)}\n".encode() + block + b"\n"
    for line, body in records:
        out += f"{line} {len(body)}\n".encode() + body + b"\n"
    return out


def test_arc_versions(spark):
    http = b"HTTP/1.0 200 OK\nServer: x\n\nbody\n\nwith gaps"
    one = arc(1, [("http://a/with space 1.2.3.4 20010203040506 text/html", http), ("dns:a 1.2.3.4 2001 text/dns", b"a 1.2.3.4")])
    two = arc(2, [("http://b/ 1.2.3.4 20010203 text/html 200 abc - 99 a.arc", http.replace(b"\n", b"\r\n"))])
    df = spark.createDataFrame([("one", one), ("two", gzip.compress(two[:50]) + gzip.compress(two[50:]))], "archive string, content binary")
    got = {r["url"]: r for r in warc.convert(df).collect()}
    assert got["http://a/with space"]["kind"] == "response" and bytes(got["http://a/with space"]["payload"]) == b"body\n\nwith gaps"
    assert got["dns:a"]["kind"] == "resource" and got["dns:a"]["warc_date"] == "2001-01-01T00:00:00Z"
    assert got["http://b/"]["warc_date"] == "2001-02-03T00:00:00Z" and bytes(got["http://b/"]["payload"]) == b"body\r\n\r\nwith gaps"
    assert len({r["record_id"] for r in got.values()}) == 3


@pytest.mark.parametrize("bad", [b"no archive\n", arc(1, [])[:-3] + b"\nhttp://x 1 2 text/html many\nabc", arc(1, [("http://x 1 2 text/html", b"abc")])[:-3]])
def test_broken_archives_are_refused(bad):
    with pytest.raises(ValueError):
        list(warc.parse_arc(bad))


def test_members_in_small_steps():
    data = b"".join(gzip.compress(os.urandom(n)) for n in (0, 1, 5000, 3))
    assert [len(m) for m in warc.members(data, 7)] == [0, 1, 5000, 3]
    with pytest.raises(ValueError):
        list(warc.members(data[:-2], 7))


def test_archive_files_are_readable_gzip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "text " * 30) for i in range(5)], PAGES)
    warc.write_archives(warc.pages_to_arc(pages, archive_bytes=300), f"file://{tmp_path}/arc")
    files = [f for f in os.listdir(tmp_path / "arc") if f.startswith("part-")]
    assert len(files) > 1
    assert sum(len(list(warc.parse_arc((tmp_path / "arc" / f).read_bytes()))) for f in files) == 5


# -- chats


def test_chat_round_trip():
    random.seed(1)
    for _ in range(1500):
        roles = ["user", "assistant", "system", "", "a<b[", "x"]
        turns = [(random.choice(roles), [chat_format.Part("text", "".join(random.choice("<>[]\\/sINST ab\n:") for _ in range(random.randint(0, 12))))]) for _ in range(random.randint(0, 4))]
        made = chat_format.format_turns(turns)
        assert chat_format.read_turns(made) == turns
        assert [chat_format.unescape(made.text[a:b]) for a, b in made.loss_spans] == [chat_format.plain(p) for r, p in turns if r == "assistant"]


def test_chat_parts():
    Part = chat_format.Part
    turns = [("user", [Part("text", "see <image:0>"), Part("image", ref="a.png", size=(100, 50)), Part("audio", ref="b.wav", size=(2.5,)), Part("document", ref="c.pdf", size=(3,)), Part("text", "x")])]
    made = chat_format.format_turns(turns)
    assert [(a.kind, a.ref, a.tokens) for a in made.attachments] == [("image", "a.png", 8), ("audio", "b.wav", 63), ("document", "c.pdf", 3072)]
    back = chat_format.read_turns(made)[0][1]
    assert [(p.kind, p.text, p.ref) for p in back] == [(p.kind, p.text, p.ref) for p in turns[0][1]]


def test_chat_report(spark):
    rows = [(1, 1, "assistant", "b[/INST]"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "assistant", "é"), (3, 0, "assistant", "é"), (None, 0, "user", "n"), (3, 1, "tool", "<s>")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat_format.report(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb[/INST]\n") and got[1]["loss_chars"] == 8 and got[1]["loss_sha256"] == sha("b[/INST]")
    assert got[3]["n_turns"] == 3 and got[3]["loss_sha256"] == sha("éé")
    assert got[-1]["turns_sha256"] == sha(f"user\n{chat_format.HARD}\nassistant\n{chat_format.HARD}\n") and got[-1]["loss_sha256"] == sha(chat_format.HARD)
    assert got[2]["turns_sha256"] == sha("\n\n") and None in got and len(got) == 5
    assert chat_format.report(df.limit(0)).count() == 1


# -- toxicity


@pytest.fixture(scope="module")
def toxic_corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice(["th", "an", "er", "in", "on", "es", "ti", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(600):
        text = [rng.choice(vocabulary) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                text[rng.randrange(60)] = rng.choice(["idiot", "moron", "pathetic"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_held_out(spark, toxic_corpus):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in toxic_corpus], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in toxic_corpus], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in toxic_corpus if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    # disguised words of texts that have no labels
    plain = toxic_corpus[1][1]
    hidden = [f"{plain} {w} {w}" for w in ("1d10t", "m0r0n", "i d i o t", "m.o.r.o.n", "idiiiiot", "p@thetic", "MORON")] + [plain, "", None]
    more = docs.unionByName(spark.createDataFrame([(10_000 + i, t, None, None, None) for i, t in enumerate(hidden)], docs.schema))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(more, labels).collect()}
    assert [got[10_000 + i] for i in range(len(hidden))] == [1] * 7 + [0] * 3


def test_toxicity_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] < 0.01 for r in toxicity.report(odd, labels).collect()} == {True}
    one = spark.createDataFrame([(0, 1, 1), (0, 1, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.report(odd, one).count() == odd.count()
    assert toxicity.report(none, labels).count() == 0


def test_decoding():
    model = toxicity.CharModel()
    for w in ("idiot", "moron", "stupid", "trash", "thing", "other"):
        model.add(w, 50)
    model.close()
    for seen, word in (("1d10t", "idiot"), ("st00pid", "stoopid"), ("s-t-u-p-i-d", "stupid"), ("tr4$h", "trash"), ("moron", "moron")):
        assert toxicity.decode(seen, model) == word, seen
    assert "stupid" in toxicity.decodings("stuuuupid", model)


def test_long_tokens_are_decoded():
    model = toxicity.CharModel()
    for w in ("idiot", "moron", "stupid", "trash", "thing", "other", "fag", "download", "report"):
        model.add(w, 50)
    scanner = toxicity.Scanner(model.close(), {"idiot": 3.0, "moron": 3.0, "fag": 3.0})
    clean = "download/rep0rt/other/thing/download/report/other/thing"
    joined = [clean + s + "1d10t" for s in "/:,'_-"]
    for token in [*joined, "f" + "@" * 60 + "g", clean + "/m-0-r-0-n", "th1ng" * 12 + "m0r0n" + "th1ng" * 3]:
        assert len(token) > 40 and scanner.facts(token)[0] == 3.0, token
    assert scanner.facts(clean)[0] == 0.0


def test_viterbi_is_exhaustive():
    """The decoder's cost is the least over all readings of the lattice."""
    import itertools
    import random

    model = toxicity.CharModel()
    for w in ("idiot", "moron", "stupid", "trash", "thing", "other", "lost", "list"):
        model.add(w, 50)
    model.close()
    rng = random.Random(2)
    for _ in range(200):
        seen = "".join(rng.choice("ilost0153@!.*t") for _ in range(rng.randint(1, 6)))
        costs = {}
        for path in itertools.product(*toxicity.lattice(seen)):
            word = "".join(x for x, _ in path)
            spelled = "^^" + word + "^"
            cost = sum(c for _, c in path) + sum(model.cost(*spelled[i - 2 : i + 1]) for i in range(2, len(spelled)))
            costs[word] = min(cost, costs.get(word, cost))
        assert costs[toxicity.decode(seen, model)] == pytest.approx(min(costs.values()))


BIG = 2**53 + 1


def test_large_keys_beside_nulls(spark, documents):
    from axisframe.llm import packing

    docs = documents([(BIG, "one two", "a"), (None, "three", "a")]).coalesce(1)
    assert {r["doc_id"] for r in packing.report(docs).collect()} == {BIG, None}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["doc_id"] for r in toxicity.report(docs, labels).collect()} == {BIG, None}
    turns = spark.createDataFrame([(BIG, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r["conv_id"] for r in chat_format.report(turns).collect()} == {BIG, None, -1}
    long = "x" * 200
    pages = spark.createDataFrame([(BIG, "u", long), (BIG + 1, "u", long), (None, "u", "b")], "page_id long, url string, html string").coalesce(1)
    assert {(r["page_id"], r["refers_to"]) for r in warc.report(pages).collect()} == {(BIG, None), (BIG + 1, BIG), (None, None)}


def test_typed_parts(spark):
    """Images, audio and documents of a column of parts become placeholders in order, with references and token counts."""
    parts = [("text", "see <b>", None, None), ("image", None, "i.png", [56.0, 29.0]), ("audio", None, "a.wav", [2.5]), ("document", None, "d.pdf", [3.0]), ("strange", "?", None, [])]
    rows = [(1, 0, "user", parts, "left out"), (1, 1, "assistant", None, "ok"), (2, 0, "user", [], None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}, text string")
    got = {r["conv_id"]: r for r in chat_format.formatted(df).collect()}
    assert got[1]["formatted"] == "<s>[INST]see <\\b><image:0><audio:1><document:2>?[/INST]<s>[OUT]ok</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 63), ("document", "d.pdf", 3072)]
    assert got[1]["expanded_tokens"] == 3139 and got[2]["expanded_tokens"] == 0
    (start, end), = got[1]["loss_spans"]
    assert got[1]["formatted"][start:end] == "ok"
    assert {r["conv_id"]: r["n_turns"] for r in chat_format.digests(chat_format.formatted(df)).collect()} == {1: 2, 2: 1}


def test_heads_end_at_the_first_empty_line():
    assert warc.split_http(b"HTTP/1.1 200 OK\nA: b\n\nx\r\n\r\ny") == (b"HTTP/1.1 200 OK\nA: b\n\n", b"x\r\n\r\ny")
    assert warc.split_http(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nx\n\ny") == (b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", b"x\n\ny")


def test_damaged_archives(spark, tmp_path):
    """Errors are rows; records around them are read, and revisits keep their length."""
    page = b"HTTP/1.0 200 OK\r\nX-Page-Id: any\r\n\r\n" + b"p" * 150
    record = lambda url: f"{url} 1.2.3.4 20240102030405 text/html {len(page)}\n".encode() + page + b"\n"
    block = b"1 0 x\n" + warc.HEADINGS[1].encode() + b"\n\n"
    opening = f"filedesc://x 0.0.0.0 20240102030405 text/plain {len(block)}\n".encode() + block
    whole = opening + record("http://a") + b"no header at all\nstill none\n" + record("http://b c") + b"http://d 1.2.3.4 20240102030405 text/html 999\nshort"
    arcs = spark.createDataFrame([("x.arc", bytearray(whole)), ("y.arc", bytearray(b"what")), ("z.arc", bytearray(b"\x1f\x8bbroken")), ("w.arc", bytearray(b""))], "archive string, content binary")
    found = warc.convert(arcs)
    assert sorted((r["kind"], r["url"], r["payload_bytes"]) for r in found.collect() if r["kind"] != "error") == [("response", "http://a", 150), ("response", "http://b c", 150)]
    assert found.filter("kind = 'error'").count() == 5
    again = warc.mark_revisits(warc.convert(arcs, with_block=False))
    path = str(tmp_path / "warc")
    from pyspark.sql import functions as F
    warc.write_warc(found.join(again, F.col("record_id") == F.col("_again"), "left").drop("_again"), path)
    assert sorted((r["record_type"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect()) == [("response", 150), ("revisit", 150)]
