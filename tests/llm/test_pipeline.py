"""Each stage of the pipeline, and all of it, against plain Python: nulls, repeated rows, clashing ids and columns, empty tables."""

import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import mixing, packing, quality

from .test_operators import brute_lines, has_content

#: Columns that the stages themselves might name so.
EXTRA = ["n_deleted", "_at", "_k", "_t", "_n", "row", "id", "h", "gone", "label", "keeper", "sid", "th", "k", "t", "n", "a.b", "mix_order"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def rows_of(texts):
    """(doc_id, text, source) to whole rows."""
    return [(d, t, "en", s, None if t is None else len(t), *(f"{c}{i % 3}" for c in EXTRA)) for i, (d, t, s) in enumerate(texts)]


def corpus(n=60, seed=0):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("abcdefghij"), 5)) for _ in range(80)]
    say = lambda k: " ".join(r.choice(words, k))
    shared = [say(9) for _ in range(4)]
    out = []
    for i in range(n):
        lines = [say(int(r.integers(6, 14))) for _ in range(int(r.integers(1, 5)))]
        if r.random() < 0.4:
            lines.insert(int(r.integers(0, len(lines) + 1)), str(r.choice(shared)))
        out.append((i, "\n".join(lines), ["src0", "src1", "src2", None, "other"][i % 5]))
    for i in range(0, 20, 2):  # near and exact copies
        w = out[i][1].split(" ")
        w[int(r.integers(len(w)))] = "changed"
        out.append((n + i, " ".join(w), "src1"))
        out.append((n + i + 1, out[i][1], "src0"))
    out += [(5, say(12), "src2"), (5, out[5][1], "src0"), (7, out[7][1], out[7][2]), (7, out[7][1], out[7][2]), (None, out[3][1], None), (None, None, "src0"), (900, None, "src1"), (901, "", "src1"), (902, "--\n--", None), (901, "", "src1")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = rows_of(corpus())
    return spark.createDataFrame(rows + [rows[-1]], SCHEMA).cache()


def multiset(rows):
    return sorted(map(str, rows))


def test_keep_quality(spark, tmp_path):
    r = np.random.default_rng(1)
    good = corpus(200, 3)
    junk = [(2000 + i, "".join(r.choice(list("#!%$ 19"), 200)), "src0") for i in range(60)]
    docs = spark.createDataFrame(rows_of(good + junk), SCHEMA)
    spark.createDataFrame([(d, 1, 0) for d, *_ in good if d is not None and d % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    net = quality.train(docs, labels)
    want = [tuple(x) for x in docs.collect() if net.score(quality.features_of([x.text or ""]))[0] >= quality.THRESHOLD]
    got = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and multiset(map(tuple, got.collect())) == multiset(want)
    assert not {x.doc_id for x in got.collect()} & {d for d, *_ in junk} and len(want) > 200
    held = quality.score_quality(docs, net).where("held_out").select("doc_id").collect()
    assert {x.doc_id for x in held} == {d for d, *_ in good + junk if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    none = docs.where("doc_id < -1")
    assert corpus_pipeline.keep_quality(spark, none, str(tmp_path)).count() == 0


def test_drop_repeated_lines(spark, docs):
    own = docs.where("doc_id is null or doc_id <> 5")  # several texts of one doc_id are ordered by a hash
    rows = [tuple(x) for x in own.collect()]
    texts = dict((d, t) for d, t, *_ in rows if d is not None and t is not None)
    after, want = brute_lines(list(texts.items()), has_content), []
    for d, t, *rest in rows:
        new = t if d is None or t is None else after[d]
        if new == t or has_content([new]):
            rest[2] = rest[2] if new == t else len(new)
            want.append((d, new, *rest))
    got = corpus_pipeline.drop_repeated_lines(spark, own, "")
    assert got.columns == docs.columns and multiset(map(tuple, got.collect())) == multiset(want)
    assert corpus_pipeline.drop_repeated_lines(spark, docs, "").count() >= len(want)
    assert corpus_pipeline.drop_repeated_lines(spark, docs.where("doc_id < -1"), "").count() == 0


def test_keep_one_of_class(spark, docs):
    rows = [(tuple(x)[:-2], x["_h"], x["_all"]) for x in docs.withColumn("_h", F.xxhash64("text")).withColumn("_all", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).collect()]

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    keys = sorted({(x[0], h) for x, h, _ in rows if x[0] is not None})
    text = {(x[0], h): x[1] for x, h, _ in rows}
    sets = [shingles(text[k]) for k in keys]
    root = list(range(len(keys)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(keys)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    stay = {keys[i] for i in range(len(keys)) if find(i) == i}  # keys are sorted, so a root is the class's first
    assert len(stay) < len(keys)
    best: dict = {}
    want = [x for x, h, _ in rows if x[0] is None]
    for x, h, every in rows:
        if (x[0], h) in stay and ((x[0], h) not in best or every < best[x[0], h][0]):
            best[x[0], h] = every, x
    want += [x for _, x in best.values()]
    got = corpus_pipeline.keep_one_of_class(spark, docs, "")
    assert got.columns == docs.columns and multiset(map(tuple, got.collect())) == multiset(want)
    # Another text under a lost row's doc_id stays, and the class's copy elsewhere is the one kept.
    same = " ".join(f"w{i}" for i in range(30))
    few = spark.createDataFrame([(1, same), (5, same), (5, "something else that stands here only once in all"), (6, same + " x")], "doc_id long, text string")
    assert sorted((x.doc_id, x.text[:4]) for x in corpus_pipeline.keep_one_of_class(spark, few, "").collect()) == [(1, "w0 w"), (5, "some")]
    assert corpus_pipeline.keep_one_of_class(spark, docs.where("doc_id < -1"), "").count() == 0


def test_mix_sources(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing.in_mixed_order, "__defaults__", (1, 4))
    monkeypatch.setattr(mixing, "CHUNK", 3)
    got = corpus_pipeline.mix_sources(spark, docs.withColumn("mix_position", F.lit("old")), "")
    assert got.columns == [*docs.columns, "mix_position"]
    out = sorted(map(tuple, got.collect()), key=lambda x: x[-1])
    assert [x[-1] for x in out] == list(range(docs.count()))
    assert multiset(x[:-1] for x in out) == multiset(map(tuple, docs.collect()))
    # Earliest deadline first over time slots by a plain loop; a source that has run out leaves its slots to the others.
    left: dict = {}
    for x in docs.collect():
        left[x.source] = left.get(x.source, 0) + 1
    order = sorted(left, key=lambda s: (s or "", s is None))
    w = {s: corpus_pipeline.WEIGHTS.get(s, 1) for s in order}
    total, done, want, t = sum(w.values()), dict.fromkeys(order, 0), [], 0
    while any(left.values()):
        ready = [(-(-(done[s] + 1) * total // w[s]), i, s) for i, s in enumerate(order) if done[s] * total // w[s] <= t]
        if ready:
            s = min(ready)[2]
            done[s] += 1
            n = min(4, left[s])
            left[s] -= n
            want += [s] * n
        t += 1
    assert [x[3] for x in out] == want
    seen = dict.fromkeys(order, 0)
    for t, s in enumerate(want[:40]):
        seen[s] += 1
    assert all(abs(seen[s] - Fraction(40 * w[s], total)) <= 8 for s in order)
    assert corpus_pipeline.mix_sources(spark, docs.where("doc_id < -1"), "").count() == 0


def first_fit(lengths, capacity):
    room, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(capacity)
        out[i] = b, capacity - room[b]
        room[b] -= lengths[i]
    return out


def test_first_fit_decreasing_is_first_fit():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 17, 300):
        lengths = r.integers(1, 65, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        assert list(zip(bins, offsets)) == first_fit(lengths.tolist(), 64)


@pytest.mark.parametrize("most", [1 << 16, 5])
def test_pack_sequences(spark, docs, monkeypatch, most):
    """Ids of the public tokenizers file, every piece once, first fit by groups, padding; also groups beyond GROUP_PIECES."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_PIECES", most)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = docs.select("doc_id", "text", (F.row_number().over(__import__("pyspark").sql.Window.orderBy("doc_id", "text")) - 1).cast("long").alias("mix_position"))
    got = corpus_pipeline.pack_sequences(spark, mixed, "").collect()
    want = []
    for doc, text, _ in mixed.collect():
        ids = np.array([*tokens.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, a, min(1024, len(ids) - a), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)]
    assert multiset((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == multiset(want)
    by: dict = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length, x.padded_length))
    for pieces in by.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and {p for _, _, p in pieces} == {at if at & (at - 1) == 0 else 1024}
    if most > 5:
        assert len(by) == max(b for b, _ in first_fit([x[2] for x in want], 1024)) + 1
    assert corpus_pipeline.pack_sequences(spark, mixed.where("doc_id < -1"), "").count() == 0


def test_tokens_of_all_code_points():
    """Both kinds of file give equal ids, over every code point in blocks with neighbours before and behind."""
    import public_tokenizers
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.tokenizer(corpus_pipeline.TOKENS)
    for a in range(0, 0x110000, 4096):
        text = "".join(f"{chr(c)}a {chr(c)}1\n" for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000)
        assert slow.encode(text, add_special_tokens=False).ids == fast(text).tolist(), hex(a)


def test_run(spark, tmp_path):
    """run() applies the stages one after another: its pieces are those of the documents that the stages keep."""
    texts = corpus(120, 5)
    docs = spark.createDataFrame([x[:5] for x in rows_of(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, *_ in texts if d is not None and d % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, str(tmp_path))
        assert out.columns[:5] == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
    kept = multiset((x.doc_id,) for x in step.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert multiset((x.doc_id,) for x in got if x.start == 0) == kept and 0 < len(kept) < len(texts)
