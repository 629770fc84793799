"""Operators over the whole corpus, against brute force and SQL, and the pipeline."""

import collections
import hashlib
import random

import pytest
from oracle import check
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm")
from tidemark.llm import components, lines, minhash, mixing, quality, registry, repeats  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, values):
    return spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in values], KIND)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    check(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def sentence(rng, n):
    return " ".join(rng.choice("red green blue one two three sun moon star sea".split()) + str(rng.randint(0, 60)) for _ in range(n))


def near_corpus():
    """Copies, near copies in a large group, short texts, nulls and repeated rows."""
    rng, out = random.Random(4), []
    base = sentence(rng, 120).split()
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    out += [sentence(rng, rng.randint(6, 80)) for _ in range(40)]
    out += [out[70], out[71].upper(), None, "", "  ", "a b", "A  b", "b a", "one two three four five", sentence(rng, 5000)]
    return [(1000 - i, t, "s") for i, t in enumerate(out)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def brute_components(values):
    sets = {d: shingles(t) for d, t, _ in values}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_duplicates(spark):
    values = near_corpus()
    got = minhash.near_duplicates(frame(spark, values)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_components(values)
    kept = {r.doc_id for r in minhash.keep_one(frame(spark, values)).collect()}
    assert kept == {r.doc_id for r in got if r.kept}


def test_near_duplicates_edge_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "x y", None), (2, "A b c d e f", None)])
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(twice).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (20, 3)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {got[k] for k in range(21)} == {0} and {got[100 + k] for k in range(30)} == {100}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng, values = random.Random(edits), []
    for _ in range(300):
        a = [rng.choice("abé") for _ in range(rng.randint(5, 20))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = [rng.choice("abé")] * rng.randint(0, 2)
            b = b or ["a"]
        values.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(values, "a string, b string").select("a", "b", lines.within_edits(F.split("a", ""), F.split("b", ""), edits).alias("w")).collect()
    assert all(r.w == (distance(r.a, r.b) <= edits) for r in got)


def line_corpus(group=60):
    """Near copies of a few lines, short lines, inserted and deleted words, blanks and repeats."""
    rng, out = random.Random(9), []
    for n in (12, 5, 30):
        base = sentence(rng, n).split()
        out.append(" ".join(base))
        for k in range(group):  # large buckets: one word changed, at the same place or anywhere
            w = list(base)
            w[n // 2 if k % 2 else rng.randrange(n)] = f"other{k}"
            out.append(" ".join(w))
            if k % 3 == 0:
                w[rng.randrange(n)] = f"more{k}"
                out.append(" ".join(w))
        for k in range(n):
            out.append(" ".join(base[:k] + ["new"] + base[k:]))
            out.append(" ".join(base[:k] + base[k + 1 :]))
    base = out[0]
    out += ["", "   ", "short", "Short", "tiny line", "a b c", "a b d", "a b c d", "a b x d", "x a b c", "b c d", base.upper(), "  " + base + " "]
    rng.shuffle(out)
    return [(d, "\n".join(out[d * 7 : d * 7 + 7]), "s") for d in range((len(out) + 6) // 7)] + [(9999, None, None), (9998, "", "s"), (9997, base + "\n" + base, "s")]


def near(a, b):
    a, b = a.split(), b.split()
    return abs(len(a) - len(b)) <= 1 and max(len(a), len(b)) >= 4 and distance(a, b) <= 1


def brute_lines(values):
    seen, first = [], {}
    occurrences = [(d, n, " ".join(x.lower().split())) for d, t, _ in sorted(values, key=lambda v: v[0]) if t is not None for n, x in enumerate(t.split("\n"))]
    gone = collections.defaultdict(list)
    found = {}
    for d, n, x in occurrences:
        if not x:
            continue
        if x not in first:
            first[x] = (d, n)
            found[x] = any(near(x, y) for y in seen)
            seen.append(x)
        if found[x] or first[x] != (d, n):
            gone[d].append(n)
    return dict(gone)


def test_line_dedup(spark):
    values = line_corpus()
    want = brute_lines(values)
    got = {r.place: r.removed for r in lines.removed_lines(frame(spark, values)).collect()}
    assert got == want
    clashing = frame(spark, values).withColumn("removed", F.lit(1)).withColumn("place", F.lit(2)).withColumn("text_hash", F.lit(3)).withColumn("at.x", F.lit(4))
    assert lines.drop_lines(clashing).columns == clashing.columns
    kept = {r.doc_id: r.text for r in lines.drop_lines(clashing).collect()}
    for d, t, _ in values:
        if t is None or d not in want:
            assert kept[d] == t
        else:
            left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d])
            assert kept.get(d, "") == left if left.strip() else d not in kept
    assert lines.removed_lines(frame(spark, [])).count() == 0


def test_line_dedup_other_ids(spark):
    docs = frame(spark, [(1, "x y z w\nother", "s"), (2, "x y z v\nother\nlast " + "long " * 30000, "s"), (None, "first of all lines\nlast " + "long " * 29999, "s")])
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.place: r.removed for r in lines.removed_lines(named).collect()} == {"1d2": [0, 1, 2]}
    assert sorted(r.text for r in lines.drop_lines(named.union(named)).collect()) == sorted(r.text for r in lines.drop_lines(named).collect() for _ in range(1, 3) if r.doc_id != "d2")


def test_line_dedup_of_a_large_group(spark):
    """5,000 near copies: the entries a line stay few, and the verdicts follow from the base line."""
    rng = random.Random(3)
    base = sentence(rng, 40).split()
    values = [(0, " ".join(base), "s")] + [(k, " ".join(w if i != k % 40 else f"v{k}" for i, w in enumerate(base)), "s") for k in range(1, 5001)]
    assert lines.removed_lines(frame(spark, values).repartition(4)).count() == 5000
    first_last = [(d, t, s) for d, t, s in values if d] + [(9000, values[0][1], "s")]
    got = {r.place for r in lines.removed_lines(frame(spark, first_last)).collect()}
    assert got == set(range(41, 5001)) | {9000}


@pytest.mark.parametrize("per_task", [repeats._PER_TASK, 400])
def test_substring_dedup(spark, monkeypatch, per_task):
    monkeypatch.setattr(repeats, "_PER_TASK", per_task)  # a small one: more partitions than the session's
    rng = random.Random(5)
    shared, other = sentence(rng, 60), sentence(rng, 36)
    values = [sentence(rng, 50) + " " + shared + " " + sentence(rng, 7), shared + " tail", "w " * 90, other + " " + sentence(rng, 40) + " " + other, sentence(rng, 34), None, "", sentence(rng, 200)]
    values += [values[-1], values[4], shared.replace(" ", "\t\n")]
    data = [(i, t, "s") for i, t in enumerate(values)] + [(3, values[3], "s")]
    counts = collections.Counter()
    for _, t, _ in data:
        w = (t or "").split()
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    got = repeats.without_repeats(frame(spark, data).withColumn("kept_text", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("places", F.lit(1))).collect()
    assert len(got) == len(data)
    for r in got:
        w = (r.text or "").split()
        gone = {k for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        assert (r.n_words, r.n_removed, r.kept_text) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_quality_limits(spark):
    rng = random.Random(6)
    common = "all rights reserved by this host for ever and ever"
    values = [(i, common + "\n" + sentence(rng, 30), "h" if i % 2 else None) for i in range(8)]
    values += [(50, common + "\n" + common, "h"), (51, "x " * 60, "h"), (52, None, "h"), (53, "", None), (54, common + "\nonly four words here", "z")]
    got = {r.doc_id: r for r in quality.verdicts(frame(spark, values), max_docs=3).collect()}
    assert got[0].removed == [] and got[1].removed == [] and got[2].removed == [0] and got[50].removed == [0, 1]
    assert got[2].kept and not got[50].kept and got[51].base_failed and got[52].base_failed and not got[53].kept and got[54].removed == []
    kept = {r.doc_id: r.text for r in quality.filter_documents(frame(spark, values), max_docs=3).collect()}
    assert kept[0] == values[0][1] and kept[2] == values[2][1].split("\n")[1] and 50 not in kept
    assert quality.verdicts(frame(spark, [])).count() == 0


def test_mix(spark):
    rng = random.Random(7)
    values = [(i, sentence(rng, rng.randint(1, 40)), s) for i, s in enumerate(["a"] * 200 + ["b"] * 40 + [None] * 100)] + [(900, None, "a"), (901, "", "zero"), (5, "same id", "b")]
    docs = frame(spark, values)
    rows_ = mixing.plan_mix(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows_:
        by[r.source][0] += r.mix_size
        by[r.source][1] += r.mix_size * r.mix_copies
        by[r.source][2] = r.mix_target
        assert r.mix_copies <= 3
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - total) < 1e-6 * total
    assert all(abs(v[1] - v[2]) <= 0.25 * v[2] for v in by.values()) and all(v[2] <= 3 * v[0] for v in by.values())
    assert mixing.mix(docs).count() == sum(r.mix_copies for r in rows_)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


CLASHES = ("k_doc", "k_hash", "k_rows", "q_doc", "q_hash", "q_removed", "mix_source", "mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies", "mix_copy", "removed", "place", "h", "key", "kept", "text_hash", "a.b")


def test_stages_of_odd_tables(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, no rows, and columns named as those of the operators."""
    import corpus_pipeline

    text = "\n".join(sentence(random.Random(k), 12) for k in range(4))
    values = [(1, text, "s"), (1, text, "s"), (None, "some words that stand in no other document of this small table at all", None), (2, None, "s"), (3, "", None), (4, " \n\t", "z")]
    odd = frame(spark, values)
    for name in CLASHES:
        odd = odd.withColumn(name, F.lit(7))
    want = {"quality_rules": 3, "line_dedup": 6, "minhash_dedup": 5, "source_mix": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, sf_dir)
        assert found.columns == odd.columns, name
        rows = found.collect()
        assert all(r[c] == 7 for r in rows for c in CLASHES) and want[name] in (None, len(rows)), (name, len(rows))
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert len(coded) == len(values) and all(r.n_tokens >= 1 for r in coded)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").cache()
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    clean = stage["line_dedup"](spark, good.cache(), sf_dir).cache()
    values = [(r.doc_id, r.text, r.source) for r in good.collect()]
    gone = brute_lines(values)
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(d, ())) for d, t, _ in values}
    assert {r.doc_id: r.text for r in clean.collect()} == {d: t for d, t in want.items() if d not in gone or t.split()}
    single = stage["minhash_dedup"](spark, clean, sf_dir).cache()
    truth = brute_components([(r.doc_id, r.text, r.source) for r in clean.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, v in truth.items() if v[2]}
    mixed = stage["source_mix"](spark, single, sf_dir).cache()
    coded = stage["sentencepiece"](spark, mixed, sf_dir).collect()
    assert len(coded) == mixed.count() and all(r.round_trip and r.n_tokens == len(r.piece_ids) for r in coded)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "source_mix", "sentencepiece"]


def brute_quality(values):
    """Per kept document its text without the lines of more than ``MAX_DOCS`` documents of its source."""
    words = {d: (t or "").split() for d, t, _ in values}
    host_docs = collections.defaultdict(set)
    norm = lambda line: " ".join(line.lower().split())
    for d, t, s in values:
        for line in (t or "").split("\n"):
            if line.split():
                host_docs[s, norm(line)].add(d)
    out = []
    for d, t, s in values:
        w = words[d]
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeated = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
            continue
        left = [x for x in t.split("\n") if len(docs := host_docs[s, norm(x)]) <= quality.MAX_DOCS or d == min(docs)]
        n = sum(len(x.split()) for x in left)
        if n >= quality.MIN_WORDS and 100 * n >= quality.MIN_LEFT_PERCENT * len(w):
            out.append((d, "\n".join(left), s))
    return out


def brute_mix(values):
    """Every document as often as the mix takes it."""
    size = collections.Counter()
    for _, t, s in values:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(order)}
    open_, rest, target = set(order), float(sum(size.values())), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > mixing.REPEAT_CAP * size[s]}
        for s in full or open_:
            target[s] = float(mixing.REPEAT_CAP * size[s]) if full else level * weight[s]
            rest -= target[s]
        open_ -= full or open_
    out = []
    for d, t, s in values:
        rate = target[s] / size[s] if size[s] else 0.0
        drawn = int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) / 2**52
        out += [(d, t, s)] * (int(rate) + (drawn < rate - int(rate)))
    return out


def test_whole_pipeline(spark, tmp_path):
    """``run`` over a written table, against its five stages by brute force."""
    import corpus_pipeline
    import sentencepiece

    from tidemark.llm import pieces

    rng = random.Random(12)
    common = "this host has written the same line below all of its pages"
    prose = lambda n: "\n".join(sentence(rng, 12) for _ in range(n))
    texts = [(prose(3) + "\n" + common, "news") for _ in range(26)] + [(prose(rng.randint(1, 5)), rng.choice(["a", "web", None])) for _ in range(40)]
    base = prose(6).split("\n")
    for _ in range(8):  # near copies: two words of each line differ, so the lines stay
        lines_ = [x.split() for x in base]
        lines_[0][3], lines_[0][8] = f"x{rng.random()}", f"y{rng.random()}"
        texts.append((" ".join(" ".join(x) for x in lines_), "web"))
    texts += [texts[30], (texts[31][0] + "\n" + prose(1), "a"), (texts[32][0].replace("\n", "\n\n"), None), (None, "a"), ("", None), ("too short", "web"), ("again and " * 40, "a"), (common, "news"), (prose(80), "long")]
    values = [(i, t, s) for i, (t, s) in enumerate(texts)]
    frame(spark, values).write.parquet(f"{tmp_path}/documents.parquet")

    good = brute_quality(values)
    gone = brute_lines(good)
    clean = [(d, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(d, ())), s) for d, t, s in good]
    clean = [(d, t, s) for d, t, s in clean if d not in gone or t.split()]
    groups = brute_components(clean)
    single = [v for v in clean if groups[v[0]][2]]
    assert len(values) > len(good) > len(clean) > len(single) > 50
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = sorted((d, s or "", sp.encode(t, add_eos=True)) for d, t, s in brute_mix(single))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.source or "", list(r.piece_ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.piece_ids) for r in got)


def test_sha_of_registered_query(spark, sf_dir):
    got = registry.QUERIES["op6_substring_dedup"](spark, sf_dir).where("n_removed = 0").limit(5).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.kept_sha256 == hashlib.sha256(" ".join(text[r.doc_id].split()).encode()).hexdigest() for r in got)
