"""Operators that rewrite or measure single documents: pieces, shards, media, pages, language."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tidemark.llm import html_text, language, matroska, perfect_hash, pieces, token_shards  # noqa: E402
from tidemark.session import fresh_path  # noqa: E402

ODD = ["a", "b", "the ", "in", " ", "  ", "\n", "é", "漢", "😀", "<s>", "</s>", "<0x41>", "\t", "\x1f", "1", ",", "th, ", "e.", "aaaa", "\x00", "́", "▁", "It's"]
EDGE = [None, "", " ", "\n", "  x", "a" * 3000, "ab" * 1500, "\x1fa  b"]


def texts(n, seed):
    rng = random.Random(seed)
    return EDGE + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def rows(spark, values, extra=""):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(values)], f"doc_id long, text string, {extra or 'piece_ids'} string")


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    values = texts(400, 1)
    df = rows(spark, values)  # with a column named like the added one
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(df)).collect()}
    digests = {r.doc_id: r for r in pieces.round_trip(df).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        ids = sp.encode(t or "", add_eos=True)
        assert got[i].piece_ids == ids and got[i].decoded == sp.decode(ids)
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.round_trip(df.limit(0)).count() == 0


def test_units_are_forgotten_without_effect():
    p = pieces.Pieces(pieces.model_path())
    p.MEMORY = 50
    values = [t or "" for t in texts(200, 2)]
    small = [p.encode(values[i : i + 10])[0].tolist() for i in range(0, len(values), 10)]
    q = pieces.pieces(pieces.model_path())
    assert small == [q.encode(values[i : i + 10])[0].tolist() for i in range(0, len(values), 10)]


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.int64)).view(np.uint64)
    h = perfect_hash.PerfectHash.from_bytes(perfect_hash.PerfectHash.build(keys).to_bytes())
    assert sorted(h.look_up(keys).tolist()) == list(range(len(keys)))


def test_shards_round_trip(spark):
    tok = token_shards.WordBpe(token_shards.vocabulary_path()).tokenizer
    values = texts(150, 3)
    data = [(i * 7 % 101, t) for i, t in enumerate(values)] + [(None, "null id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    path = fresh_path(spark, "shards")
    token_shards.write_shards(df, path, shard_bytes=400)
    got = token_shards.read_digests(spark, path).collect()
    encode = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda d, n, c: (-1 if d is None else d, n, c)
    assert sorted(key(r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(key(d, len(encode(t)), crc(encode(t))) for d, t in data)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    shard = token_shards.Shard(spark.read.parquet(f"{path}/shards").orderBy("first_doc").first().asDict())
    one = int(shard.docs[-1])
    assert shard.get(one).tolist() in [encode(t) for d, t in data if d == one] and shard.get(10**12) is None
    empty = fresh_path(spark, "shards")
    token_shards.write_shards(df.limit(0), empty)
    assert token_shards.read_digests(spark, empty).count() == 0


def test_media_round_trip(spark):
    values = [*EDGE, "y" * 575, "y" * 576, "y" * (576 * 300 + 1)]
    df = rows(spark, values, "media")
    got = {r.doc_id: r for r in matroska.media_digests(matroska.media_column(df)).collect()}
    for i, t in enumerate(values):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
    assert got[0].feature == got[1].feature and "indexed=1" in got[len(values) - 1].feature
    packets = matroska.packet_table(matroska.media_column(df.where(F.col("doc_id") == len(values) - 1))).collect()
    assert [p.time_ns for p in packets] == [k * 72_000_000 for k in range(301)] and {p.size for p in packets} == {576}
    assert matroska.packet_table(spark.createDataFrame([(1, None)], "k int, media binary")).count() == 0


def test_all_lacings_and_unknown_sizes():
    m = matroska
    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d" * 700]
    head = b"\x81" + struct.pack(">h", 5)
    xiph = head + bytes([0x82, 3, 255, 45, 10, 255, 0]) + b"".join(frames)
    def signed(n, width=2):
        return ((n + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")

    ebml = head + bytes([0x86, 3]) + (300 | 1 << 14).to_bytes(2, "big") + signed(-290) + signed(245) + b"".join(frames)
    plain = head + b"\x00" + frames[0]
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, plain) + m.element(m.REFERENCE, b"\x01"))
    blocks = m._uint(m.CLUSTER_TIME, 100) + m.element(m.SIMPLE_BLOCK, xiph) + m.element(m.SIMPLE_BLOCK, ebml) + group
    body = m._id(m.CLUSTER) + b"\x01" + b"\xff" * 7 + blocks
    data = m._HEADER + m._id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + m._TRACKS + body
    found = m.parse(data)
    sizes = [300, 10, 255, 700]
    assert [p.size for p in found.packets] == [*sizes, *sizes, 300]
    assert m.stored_payload(data, found) == b"".join(frames) * 2 + frames[0]
    assert found.packets[0].time_ns == 105 * m.TIME_SCALE and found.packets[-1].keyframe is False
    for cut in range(0, len(data), 97):  # bytes that end anywhere
        assert len(m.parse(data[:cut]).packets) <= len(found.packets)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><a>Home</a></nav><div class="ad">Buy this long long advert text now</div>
<article><h1>Head</h1><p><b>One &amp; two<br><p>Three <i>four</i>.</p><script>x="</p>"</script><p>Short.</p><div class="comments"><p>I disagree with everything here.</p></div></article>
<aside><p>See also this</p></aside><form><p>Mail</p></form><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    pages = [PAGE, None, "", "only text", "<p>a<p>b", "<div><div><p>x y z, long enough to stay here.</div><p>end"]
    df = spark.createDataFrame([(i, f"u{i}", h, 0) for i, h in enumerate(pages)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[0].text == "Head\n\nOne & two\n\nThree four.\n\nShort."
    assert got[1].text == "" and got[2].text == "" and got[3].text == "only text" and got[4].text == "a\n\nb"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs.where("doc_id % 2 = 0"), per_language=30)
    got = language.predict(docs.where("doc_id % 2 = 1").withColumn("score", F.lit("clash")), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(odd, model).collect()] == [("und", 0.0)] * 3
    none = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predict(docs.limit(5), none).collect()} == {"und"}


def test_pages_whose_head_or_form_spans_the_page():
    body = "<article><h1>Head</h1><p>One long enough line of the text.</p><p>Short.</p></article>"
    want = ["Head", "One long enough line of the text.", "Short."]
    for start in ("<head><title>x</title><body>", "<head><title>x</title>", "<head><meta charset=a><script>y</script><body><nav>Home</nav>"):
        assert html_text.main_blocks(f"<html>{start}{body}") == want
    assert html_text.main_blocks("<head><title>x</title>plain text") == ["plain text"]
    assert html_text.main_blocks("<head><title>x</title><a>linked</a> text") == ["linked text"]
    assert html_text.main_blocks(f"<body><form><nav>Home</nav>{body}<button>Go</button></form></body>") == want
    assert html_text.main_blocks("<body><form><div><p>All of the text is here.<p>And here.</div></form></body>") == ["All of the text is here.", "And here."]
    assert html_text.main_blocks("<body><div><p>All of the text is here, and it is long.</div><form>Mail</form></body>") == ["All of the text is here, and it is long."]


def test_pages_of_several_regions():
    long = [f"Part {k} is a line of text that is long enough to be dense, and goes on and on. " * (20 if k == 0 else 2) for k in range(3)]
    want = [t.strip() for t in long]
    assert html_text.main_blocks("<body>" + "".join(f"<div><p>{t}</p></div>" for t in long) + "</body>") == want
    assert html_text.main_blocks("<body>" + "".join(f"<article><p>{t}</p></article>" for t in long) + "<div>Else</div></body>") == want
    assert html_text.main_blocks(f"<main><p>{long[1]}</p><article><p>{long[0]}</p></article><p>{long[2]}</p></main>") == [want[1], want[0], want[2]]


def test_no_language_is_lost_to_long_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_CHARS", 800)
    values = [(k, "long " * 100, "a") for k in range(20)] + [(100 + k, f"text {k}", "a") for k in range(20)] + [(200, "b" * 700, "b"), (201, "b" * 600, "b")]
    sample = language.training_sample(spark.createDataFrame(values, "doc_id long, text string, lang string"))
    assert sorted(zip(*sample, strict=True)) == sorted([(t, lang) for _, t, lang in values if len(t) < 100] + [("b" * 600, "b")])
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        language.train(spark.createDataFrame(values, "doc_id long, text string, lang string"))


def test_added_tokens_are_matched_by_case():
    bpe = token_shards.WordBpe(token_shards.vocabulary_path())
    values = ["a <|ENDOFTEXT|> b", "a <|endoftext|> b", "X<|StartOfText|>Y, Z.", "<|startoftext|>A. B", "Plain Text, here.", "é <|ENDOFTEXT|>"]
    ids, offsets = bpe.encode(values)
    for t, a, b in zip(values, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*bpe.tokenizer.encode(t, add_special_tokens=False).ids, token_shards.END_ID]


def test_a_word_is_one_unit_whatever_stands_around_it():
    bpe = token_shards.WordBpe(token_shards.vocabulary_path())
    given, encode = [], bpe.memory.encode
    bpe.memory.encode = lambda units: given.extend(units) or encode(units)
    bpe.encode(["Vlurbo, (vlurbo) vlurbo!", "é vlurbo&&& crèvlu. crèvlu,a", None, ""])
    assert sorted(given) == sorted(["vlurbo", "crèvlu", "é", "a", ",", ".", "!", "(", ")", "&&&"])
    texts, library = [], bpe._library
    bpe._library = lambda values: texts.extend(values) or library(values)
    values = [" ".join("qzx" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(600))]
    ids, _ = bpe.encode(values)
    assert len(texts) == 3 and ids.tolist() == [*bpe.tokenizer.encode(values[0], add_special_tokens=False).ids, token_shards.END_ID]


def test_cut_units_equal_the_library(tmp_path):
    import json

    bpe = token_shards.WordBpe(token_shards.vocabulary_path())
    marks = [*"abzSTZ09.,!'<|>&é×İŉſßʰΣ漢²", "'s", "'RE", "<|endoftext|>", "<|STARTOFTEXT|>", "\u0301", "\u0338", "\u0307", "\u0308", "\u1100", "\u1161", " ", " ", "\n", "\t", "\xa0"]
    rng = random.Random(8)
    values = [None, "", *("".join(rng.choices(marks, k=rng.randint(1, 12))) for _ in range(20_000))]
    values += [f"a{chr(c)}, {chr(c)}b {chr(c)},{chr(c)}.A{chr(c)}" for c in range(0x2100)]
    spec = json.load(open(token_shards.vocabulary_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"  # no word ends before a comma
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other = token_shards.WordBpe(str(tmp_path / "other.json"))
    assert bpe.cuts and not other.cuts
    for tok, some in ((bpe, values), (other, values[:2000])):
        ids, offsets = tok.encode(some)
        want = tok.tokenizer.encode_batch_fast([t or "" for t in some], add_special_tokens=False)
        for t, a, b, e in zip(some, offsets[:-1], offsets[1:], want, strict=True):
            assert ids[a:b].tolist() == [*e.ids, token_shards.END_ID], t
    assert bpe.encode([None, ""])[0].tolist() == [token_shards.END_ID] * 2


def test_html_regions_follow_the_threshold(monkeypatch):
    links = "".join(f"<li><a href='/{k}'>part {k}</a></li>" for k in range(9))
    text = "".join(f"<p>{'A sentence of this page that goes on for some words. ' * 3}</p><p>Short {k}.</p>" for k in range(4))
    page = f"<html><body><div><ul>{links}</ul></div><div><h2>Title</h2>{text}</div><div class='footer'>Imprint</div></body></html>"
    want = html_text.main_blocks(f"<article><h2>Title</h2>{text}</article>")
    assert len(want) == 9 and html_text.main_blocks(page) == want  # no element that says so by its kind
    two = page.replace("<p>Short 1.</p>", "</div><div><ul>" + links + "</ul></div><div><p>Short 1.</p>")
    assert html_text.main_blocks(two) == want
    monkeypatch.setattr(html_text, "threshold", lambda values: 0.0)
    assert html_text.main_blocks(page) != want


def test_html_smoothing_and_threshold_by_hand():
    values = [0.0, 10.0, 0.0, 200.0, 180.0]
    kernel = {d: 2.718281828459045 ** (-d * d / 2) for d in range(-3, 4)}
    want = [sum(kernel[i - j] * v for j, v in enumerate(values) if abs(i - j) <= 3) / sum(kernel[i - j] for j in range(5) if abs(i - j) <= 3) for i in range(5)]
    assert html_text.smoothed(values) == pytest.approx(want)
    assert 1 < html_text.threshold([0.0, 1.0, 5.0, 6.0]) < 5 and html_text.threshold([3.0]) == 3.0


def test_html_of_any_depth_in_linear_time():
    import time

    start = time.perf_counter()
    assert len(html_text.main_blocks("<div>" * 30000 + "text " * 5 + "<p>x</b>" * 30000)) == 30001
    assert len(html_text.main_blocks("<ul>" + "<div>" * 20000 + "<li>x" * 20000 + "<b>" * 20000 + "<h1>t</h1>" * 20000)) == 40000
    assert time.perf_counter() - start < 60


def test_units_are_forgotten_by_their_ids():
    from tidemark.llm.units import UnitMemory

    def encode(units):
        return np.array([ord(c) for u in units for c in u], np.int64), np.array([len(u) for u in units], np.int64)

    memory = UnitMemory(encode, limit=10**6, limit_ids=1000)
    for k in range(50):
        keys = ["ab", chr(1000 + k) * 90, "ab", "ab"]
        ids, offsets = memory.rows([keys, []], 7)
        assert ids.tolist() == [ord(c) for u in keys for c in u] + [7, 7] and offsets.tolist() == [0, 97, 98]
        assert memory.used < 1200
    assert "ab" in memory.numbers


def test_language_kernel_by_brute_force():
    texts = ["Ein kurzer Satz, 12 Worte.", "another sentence of words", "x", "lang und länger " * 900, "é1é"]

    def grams(window, n):
        return {window[i : i + n] for i in range(len(window) - n + 1)}

    marks = [language.windows(t)[0] for t in texts]
    present = language.presence(marks)
    got = language.text_kernel(texts, present, language._scales(present))
    for i, text in enumerate(texts):
        cut = language.windows(text)
        assert all(len(w) <= language.WINDOW + 3 for w in cut) and b"".join(w[3 if k else 0 :] for k, w in enumerate(cut)).decode().split() == "".join(c.lower() if c.isalpha() else " " for c in text).split()
        for j, mark in enumerate(marks):
            want = 0.0
            for w in cut:
                for n in language.ORDERS:
                    a, b = grams(w, n), grams(mark, n)
                    want += len(a & b) / max(1, len(a)) ** 0.5 / max(1, len(b)) ** 0.5 / len(language.ORDERS) / len(cut)
            assert abs(got[i, j] - want) < 0.03  # n-grams that share a slot


def test_language_of_texts_of_any_length():
    import random

    rng = random.Random(2)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)] for k, letters in {"aa": "abcdeilmno", "bb": "aghknrstuw", "cc": "äöübdefigl"}.items()}
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    model = language.fit([text(k, rng.randint(5, 300)) for k in words for _ in range(40)], [k for k in words for _ in range(40)])
    scorer, scores = language.Scorer(model), {}
    for n in (5, 50, 500, 20000):
        names, found = scorer.predict([text(k, n) for k in words])
        assert names == list(words)
        scores[n] = min(found)
    assert scores[20000] > 0.9 * scores[500] and scores[500] > 0.7
