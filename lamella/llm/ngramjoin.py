"""N-gram Jaccard join: grouped prefix join over word shingles, giving each document's class of linked documents.

1. Texts become sets of hashed shingles; equal sets are one from there on (`sid`, a 64-bit hash of the set).
2. A set with a partner shares all but a fifth of its shingles with it (at a similarity of 0.8), so sets with more
   shingles that stand nowhere else leave. Shingles are counted in buckets of their hash; long sets bring the quarter of their shingles whose hash
   is divisible by 4 (a share that depends on the shingle alone, so partners bring the same ones).
3. Survivors' prefixes, rarest shingles first, are taken from the same shingles. Sets with equal size and prefix form
   one group. Groups meet on prefix shingles; pairs must pass the bounds on size and on position.
4. Group pairs are expanded to members and verified on their whole sets. Of a group, and of a prefix shingle's groups,
   first each meets a hub only; what is then in one class needs no more comparing, and only pairs between different
   classes are expanded. So a large group of copies costs a star, not all pairs.
5. Classes are connected components of the verified links, by large-star and small-star rounds.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_counted, likely_in, map_texts, slices, typed

SMALL = 160  # sets up to this size bring all shingles to step 2
BUCKET_TOKENS = 1 << 17
BROADCAST_IDS = 1 << 20
TEXTS = 1 << 20  # bytes of texts that a Python worker hashes at a time
STRETCH = 1 << 16  # bytes of their words that are hashed at a time
SLICE = 2 << 20  # bytes of packed shingles that a Python worker handles at a time
CARRIED = 240  # sets up to this size carry their prefix
STIR1, STIR2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LOW48 = np.uint64((1 << 48) - 1)
OWNER = "greatest(sid & 4294967295, 1)"  # SQL of owners()


class Rule(NamedTuple):
    """Shingles of so many words; two sets link when den * intersection >= num * union. Below 3/4 most sets are tested whole."""

    words: int = 5
    num: int = 80
    den: int = 100

    def missing(self, n: int) -> int:
        """Shingles of a set of n that a partner may lack."""
        return n - -(-n * self.num // self.den)

    def missing_col(self, n: str) -> Column:
        return F.expr(f"{n} - ({n} * {self.num} + {self.den - 1}) div {self.den}")

    def needed(self, n: str, m: str) -> str:
        """SQL: the smallest intersection of sets of n and m that links them."""
        return f"(({n} + {m}) * {self.num} + {self.num + self.den - 1}) div {self.num + self.den}"

    def fits(self, x: str, y: str) -> str:
        """SQL on a pair of postings: bounds on size, and on what can be shared from the places on."""
        sizes = f"{x}.n * {self.num} <= {y}.n * {self.den} and {y}.n * {self.num} <= {x}.n * {self.den}"
        return f"{sizes} and least({x}.n - {x}.rank, {y}.n - {y}.rank) >= {self.needed(f'{x}.n', f'{y}.n')}"

    def parity_fits(self, x: str, y: str) -> str:
        """SQL: the parity cells differ in no more places than linked sets can."""
        differ = " + ".join(f"bit_count({x}.b{k} ^ {y}.b{k})" for k in range(4))
        return f"({differ}) <= {x}.n + {y}.n - 2 * ({self.needed(f'{x}.n', f'{y}.n')})"

    def all_tested(self) -> int:
        """Largest set that is tested on all its shingles; its partners have SMALL at most, so they bring all of theirs."""
        return SMALL * self.num // self.den


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case byte, whether it separates words, a random odd number for each byte)."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return low, blank, np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


LOW, BLANK, ODD = tables()


def stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * STIR1
    x = (x ^ (x >> np.uint64(29))) * STIR2
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. Fewer words than a shingle: the whole sequence is one."""
    data = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    b = LOW[np.frombuffer(b"".join(data), np.uint8)]
    inside = ~BLANK[b]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = np.concatenate([[0], np.searchsorted(start, np.cumsum([len(d) for d in data]))])
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    n = end - start
    begin = np.cumsum(n) - n
    power = np.cumprod(np.full(int(n.max()), STIR1 | np.uint64(1), np.uint64))
    letters, sums = b[inside], []
    # Words in stretches of bytes: what follows takes some thirty times a stretch's bytes.
    for i, j in pairwise(np.unique([*np.searchsorted(begin, np.arange(0, len(letters), STRETCH)), len(begin)]).tolist()):
        low, high = begin[i], begin[j - 1] + n[j - 1]
        at = np.arange(low, high) - np.repeat(begin[i:j], n[i:j])
        sums.append(np.add.reduceat(ODD[letters[low:high]] * power[at], begin[i:j] - low))
    w = stir(np.concatenate(sums))
    s = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for j in range(words):
        turn = np.uint64(7 * j + 1)
        s += stir((w[j : j + len(s)] << turn | w[j : j + len(s)] >> (np.uint64(64) - turn)) + np.uint64(j)) if len(s) else s
    s = stir(s)
    out = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        if z - a >= words:
            out.append(np.unique(s[a : z - words + 1]))
        else:
            short = np.uint64(z - a)
            for x in w[a:z]:
                short = stir(np.array([short]) + x)[0]
            out.append(np.array([short] if z > a else [], np.uint64))
    return out


def narrow(tokens: np.ndarray) -> bytes:
    """48 bits of each hash, as bytes."""
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


SETS = "doc_id long,th long,sid long,n int,n0 int,brought int,tested int,toks binary,b0 long,b1 long,b2 long,b3 long"


def set_rows(batch: pa.RecordBatch, rule: Rule) -> dict:
    """Of each text: sid, size n, sampled part n0, the shingles it brings (toks), how many of them its own test uses,
    and the parity of its shingles in 256 cells (the number of differing cells is at most that of differing shingles)."""
    cols: dict[str, list] = {x.split()[0]: [] for x in SETS.split(",")}
    for doc, th, s in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), shingles([t or "" for t in batch.column("text").to_pylist()], rule.words)):
        n, few = len(s), s[(s & np.uint64(3)) == 0]
        whole = n <= SMALL or len(few) <= rule.missing(n)
        bring = s if whole else few
        bits = np.packbits((np.bincount((s >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view("<i8").tolist()
        sid = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
        tested = n if n <= rule.all_tested() else len(few)
        for k, x in zip(cols, (doc, th, sid, n, len(few), len(bring), tested, narrow(bring), *bits)):
            cols[k].append(x)
    return cols


def owners(sid: np.ndarray) -> np.ndarray:
    """32 bits of each sid, never 0."""
    return np.maximum(sid & 0xFFFFFFFF, 1).astype("<u4")


def token_rows(buckets: int, rule: Rule):
    """Slices of sets to rows by bucket of the hash. A shingle that several sets of a slice hold goes out once.

    Shingles and their sets go out as 32 bits each: equal bits of different ones only make shingles count as shared, so
    that more sets survive, never fewer.
    """
    names = ["bucket", "once", "owner", "more", "known"]

    def run(batches):
        for b in slices(batches, "toks", SLICE):
            sizes = [len(x) // 6 for x in b.column("toks").to_pylist()]
            if not sum(sizes):
                continue
            tok = widen(b"".join(b.column("toks").to_pylist()))
            sid, n = np.array(b.column("sid").to_pylist(), np.int64), np.array(b.column("n").to_pylist())
            own = np.repeat(np.arange(len(sid)), sizes)
            counts = (n[own] <= rule.all_tested()) | ((tok & np.uint64(3)) == 0)
            order = np.argsort(tok, kind="stable")
            tok, own, counts = tok[order], own[order], counts[order]
            new = np.concatenate([[True], tok[1:] != tok[:-1]])
            alone = new & np.concatenate([new[1:], [True]])
            part = (tok >> np.uint64(8) & np.uint64(buckets - 1)).astype(np.int64)
            sid, tok = owners(sid), stir(tok).astype("<u4")
            by = np.argsort(part, kind="stable")
            present, begin = np.unique(part[by], return_index=True)
            rows = []
            for k, i in zip(present.tolist(), np.split(by, begin[1:])):
                one, first = i[alone[i]], i[new[i] & ~alone[i]]
                credit = np.bincount(own[i[~alone[i] & counts[i]]], minlength=len(sid))
                has = np.flatnonzero(credit)
                known = np.stack([sid[has], credit[has]], 1).astype("<u4")
                rows.append((k, tok[one].tobytes(), np.where(counts[one], sid[own[one]], 0).astype("<u4").tobytes(), tok[first].tobytes(), known.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    schema = "bucket long,once binary,owner binary,more binary,known binary"
    return typed(run, schema), schema


def credits(table: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: how many shingles of each set stand in another set too."""
    once, owner, more, known = (np.frombuffer(b"".join(table[c]), "<u4") for c in ("once", "owner", "more", "known"))
    known = known.reshape(-1, 2)
    seen, at, count = np.unique(once, return_inverse=True, return_counts=True)
    shared = (count[at] > 1) | np.isin(seen, more)[at] if len(once) else np.zeros(0, bool)
    own = owner[shared & (owner != 0)]
    sets, at = np.unique(np.concatenate([own, known[:, 0]]), return_inverse=True)
    got = np.bincount(at, weights=np.concatenate([np.ones(len(own)), known[:, 1]]), minlength=len(sets))
    return pd.DataFrame({"owner": sets.astype(np.int64), "got": got.astype(np.int64)})


def survivors(work: Scratch, real: DataFrame, tokens: int, rule: Rule) -> DataFrame:
    """(sid, doc_id, th, copies): sets of which a partner can exist, judged by the shingles that stand in no other set,
    with their first row by (doc_id, th) and the number of rows that have them."""
    buckets = 1 << max(0, (tokens // BUCKET_TOKENS).bit_length())
    fn, schema = token_rows(buckets, rule)
    unique = real.groupBy("sid").agg(F.min_by(F.struct("n", "toks"), "doc_id").alias("x")).select("sid", "x.*")
    rows = unique.mapInArrow(fn, schema)
    got = rows.groupBy("bucket").applyInPandas(credits, "owner long,got long").groupBy("owner").agg(F.sum("got").alias("got"))
    one = real.groupBy("sid").agg(F.min("n").alias("n"), F.min("tested").alias("tested"), F.min(F.struct("doc_id", "th")).alias("d"), F.count(F.lit(1)).alias("copies"))
    kept = one.withColumn("owner", F.expr(OWNER)).join(got, "owner").where(F.col("tested") - F.col("got") <= rule.missing_col("n"))
    return work.table("survivors", kept.select("sid", "d.*", "copies"))


def prefixes(work: Scratch, held: DataFrame, rule: Rule) -> DataFrame:
    """(sid, n, h, rank): the prefix shingles that stand in two sets or more; rank is the place in the global order
    (sampled ones first, then by frequency, then by hash), counting the others too."""
    schema = "sid long,h long,rest int"

    def run(batches):
        for b in slices(batches, "toks", SLICE // 2):
            sizes = [len(x) // 6 for x in b.column("toks").to_pylist()]
            tok = widen(b"".join(b.column("toks").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(b.column("sid").to_pylist(), np.int64), sizes)), pa.array(tok.astype(np.int64)), pa.array(((tok & np.uint64(3)) != 0).astype(np.int32))], ["sid", "h", "rest"])

    posts = work.table("posts", held.select("sid", "toks").mapInArrow(typed(run, schema), schema))
    df = work.table("df", posts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("df", F.col("n")))
    shared = join_counted(posts, df, ["h"]).join(held.select("sid", "n", "n0", "brought"), "sid")
    per = Window.partitionBy("sid", "rest")
    alone = F.when(F.col("rest") == 0, F.col("n0")).otherwise(F.col("brought") - F.col("n0")) - F.count(F.lit(1)).over(per)
    rank = F.row_number().over(per.orderBy("df", "h")) - 1 + alone + F.when(F.col("rest") == 1, F.col("n0")).otherwise(0)
    cut = shared.withColumn("rank", rank.cast("int")).where(F.col("rank") <= rule.missing_col("n"))
    return cut.select("sid", "n", "h", "rank", "rest", "df")


def verify(work: Scratch, name: str, pairs: DataFrame, full: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose whole sets link. Pair by pair in the JVM: sets aren't gathered in batches, however long they are."""
    met = pairs.join(full.withColumnsRenamed({"sid": "a", "toks": "x"}), "a").join(full.withColumnsRenamed({"sid": "b", "toks": "y"}), "b")
    same, both = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
    return work.table(name, met.where(rule.den * same >= rule.num * (both - same)).select("a", "b"))


def are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no other's smaller end, so that the smaller ends are the labels."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("x", "up", "down"))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(work: Scratch, name: str, links: DataFrame) -> DataFrame:
    """(sid, label): smallest sid that links lead to, for every sid with a link. Rounds of large and small stars, each
    written to the shared folder; a node's links are never gathered, only their smallest end."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, k = work.table(f"{name}0", edges), 0
    while not are_stars(edges):
        k += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.table(f"{name}{k}l", large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = work.table(f"{name}{k}", small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        work.drop(f"{name}{k}l", f"{name}{k - 1}")
    roots = edges.select(F.col("v").alias("sid"), F.col("v").alias("label")).distinct()
    return work.table(f"{name}-labels", edges.select(F.col("u").alias("sid"), F.col("v").alias("label")).unionByName(roots))


def links_between(work: Scratch, docs: DataFrame, alive: DataFrame, held: DataFrame, rule: Rule) -> DataFrame:
    """(sid, label) of all linked sets; alive has the row whose text a set is made from again."""
    pre = prefixes(work, held, rule)
    # Groups: equal size and prefix. gid is the smallest sid; the place of its first shingle is the least of its members'.
    lists = pre.groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("rest", "df", "h"))).alias("p"), F.min("rank").alias("rank"))
    lists = lists.select("sid", "n", "rank", F.xxhash64("p.h", "n").alias("grp"), F.col("p.h").alias("hs"))
    parity = held.select("sid", "b0", "b1", "b2", "b3")
    member = work.table("member", lists.select("sid", "n", "rank", "grp", "hs").join(parity, "sid"))
    # Members of a group hold the same prefix, so any one's will do; only smallest values are gathered.
    groups = member.groupBy("grp").agg(F.min("sid").alias("gid"), F.min("n").alias("n"), F.min("rank").alias("rank"), F.min_by("hs", "sid").alias("hs"), *[F.min_by(f"b{k}", "sid").alias(f"b{k}") for k in range(4)], F.count(F.lit(1)).alias("members"))
    groups = work.table("groups", groups)
    member = member.drop("hs").join(groups.select("grp", "gid"), "grp")
    member = work.table("members", member.drop("grp"))
    work.drop("posts", "df", "member")
    posts = work.table("keys", groups.select("gid", "n", "members", "b0", "b1", "b2", "b3", "rank", F.posexplode("hs").alias("i", "h")).withColumn("rank", F.col("rank") + F.col("i")).drop("i"))
    hub = posts.groupBy("h").agg(F.min(F.struct("rank", "gid")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", F.col("hub.gid").alias("hub"), "c")
    hub = work.table("hubs", hub)
    # Stars: members with their group's hub, groups with their shingles' hubs.
    cells = ["n", "b0", "b1", "b2", "b3"]
    others = member.where("sid <> gid").select("gid", "sid", F.struct(*cells).alias("x"))
    inner = join_counted(others, groups.where("members > 1").select("gid", F.struct(*cells).alias("y"), "members"), ["gid"], "members")
    inner = inner.where(F.expr(rule.parity_fits("x", "y"))).select(F.col("sid").alias("a"), F.col("gid").alias("b"))
    hubs = join_counted(posts, hub, ["h"], "c").where("gid <> hub").select("gid", "hub").distinct()
    outer = hubs.join(groups.alias("x"), F.col("x.gid") == hubs["gid"]).join(groups.alias("y"), F.col("y.gid") == hubs["hub"]).where(F.expr(f"{rule.fits('x', 'y')} and {rule.parity_fits('x', 'y')}")).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
    stars = work.table("stars", inner.unionByName(outer).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    full = whole_sets(work, "star-sets", docs, alive, stars, rule)
    links = verify(work, "star-links", stars, full, rule)
    work.drop("star-sets", "star-sets-once", "stars")
    labels = components(work, "star", links)
    # Rest: on each shingle, members of another class than the hub's meet all others of another class than their own.
    member = member.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    parity = ["b0", "b1", "b2", "b3"]
    lists = work.table("lists", member.join(groups.select("gid", "hs"), "gid").select("sid", "label", "n", *parity, F.col("rank").alias("_first"), "hs"))
    posts = lists.select("*", F.posexplode("hs").alias("i", "h")).withColumn("rank", F.col("_first") + F.col("i")).drop("i", "_first")
    posts = posts.withColumn("hs", F.when(F.size("hs") <= rule.missing(CARRIED), F.col("hs")))
    hub = hub.join(member.select(F.col("sid").alias("hub"), F.col("label").alias("hub_label")), "hub").select("h", "hub_label")
    # A shingle that one group alone holds, with several members, has the smallest sid's class for its hub's.
    own = posts.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min_by("label", "sid").alias("own"))
    named = own.join(hub, "h", "left").where("c > 1").select("h", F.coalesce("hub_label", "own").alias("hub_label"), "c")
    listed = work.table("listed", join_counted(posts, work.table("named-hubs", named), ["h"], "c"))
    # Of short prefixes a pair counts on its first common shingle only (long ones would be a burden to carry, and large
    # sets share few); among the rest, that with the smaller sid leads.
    rest = listed.where("label <> hub_label")
    lead = "(y.label = y.hub_label or x.sid < y.sid)"
    first = "(x.hs is null or y.hs is null or get(filter(x.hs, s -> array_contains(y.hs, s)), 0) = x.h)"
    met = rest.alias("x").join(listed.alias("y"), F.expr(f"x.h = y.h and x.sid <> y.sid and x.label <> y.label and {lead} and {rule.fits('x', 'y')} and {rule.parity_fits('x', 'y')} and {first}"))
    more = work.table("more", met.select(F.greatest("x.sid", "y.sid").alias("a"), F.least("x.sid", "y.sid").alias("b")).distinct())
    more_links = verify(work, "more-links", more, whole_sets(work, "more-sets", docs, alive, more, rule), rule)
    work.drop("keys", "hubs", "named-hubs", "lists", "listed", "more", "more-sets", "more-sets-once", "groups", "members")
    return components(work, "all", links.unionByName(more_links))


def whole_sets(work: Scratch, name: str, docs: DataFrame, alive: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(sid, toks) with all shingles (48 bits of each) of the sets in pairs, made again from one text each."""
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    ids = work.table(f"{name}-ids", alive.join(wanted, "sid").select("sid", "doc_id", "th"))
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    texts = (texts.join(F.broadcast(ids), ["doc_id", "th"]) if small else likely_in(texts, ids, "th").join(ids, ["doc_id", "th"])).select("sid", "text")

    def rows(batch: pa.RecordBatch) -> dict:
        found = shingles([t or "" for t in batch.column("text").to_pylist()], rule.words)
        ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
        flat = (np.concatenate(found) & LOW48).astype(np.int64)
        return {"sid": batch.column("sid"), "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    made = work.table(name, map_texts(texts, rows, "sid long,toks array<bigint>", ["sid", "text"], max_bytes=TEXTS), "snappy")
    if made.groupBy("sid").count().where("count > 1").isEmpty():
        return made
    return work.table(f"{name}-once", made.dropDuplicates(["sid"]), "snappy")  # fully repeated rows of docs


def jaccard_rows(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id, keeper.

    text_hash is xxhash64 of the text. keeper is the (doc_id, text_hash) of the class's first row in that order, so it
    tells apart several texts of one doc_id; null for rows that link with nothing by rule (see jaccard_classes).
    """
    work = Scratch(docs.sparkSession, "jaccard")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    sets = work.table("sets", map_texts(keyed, lambda b: set_rows(b, rule), SETS, ["doc_id", "th", "text"], max_bytes=TEXTS), "snappy")
    real = sets.where("n > 0 and doc_id is not null")
    tokens = real.agg(F.sum("brought")).first()[0] or 0
    columns = ["n", "n0", "brought", "tested", "toks", "b0", "b1", "b2", "b3"]
    alive = survivors(work, real, tokens, rule)
    # Only a set's first row meets it, so copies of one set, however many, don't come together; fully repeated rows do.
    # Most sets don't survive: their shingles stay where they lie.
    held = likely_in(real, alive, "sid").join(alive.drop("copies"), ["sid", "doc_id", "th"]).groupBy("sid").agg(F.min_by(F.struct(*columns), "doc_id").alias("x")).select("sid", "x.*")
    labels = links_between(work, docs, alive, work.table("held", held, "snappy"), rule)
    labels = work.table("counted", labels.join(alive.select("sid", "copies"), "sid"))
    rows = lambda df: df.select("sid", "doc_id", F.col("th").alias("text_hash"), F.col("n").cast("long").alias("n_shingles"))
    named = work.table("named", join_counted(rows(real), labels, ["sid"], "copies", "left").withColumn("label", F.coalesce("label", "sid")).drop("sid"))
    bare = work.table("bare", rows(sets.where("n = 0 or doc_id is null")).drop("sid"))
    work.drop("sets", "held", "survivors", "counted", "all-labels", "star-labels")
    mine = F.struct("doc_id", "text_hash")
    first = work.table("first", named.groupBy("label").agg(F.min(mine).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    out = join_counted(named, first, ["label"], how="left").withColumn("keeper", F.coalesce("keeper", mine))
    out = out.select("doc_id", "text_hash", "n_shingles", F.col("keeper.doc_id").alias("component_id"), "keeper")
    return out.unionByName(bare.select("*", F.col("doc_id").alias("component_id"), F.lit(None).cast(out.schema["keeper"].dataType).alias("keeper")))


def jaccard_classes(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Words are runs of bytes other than space and \\t..\\r, A-Z lowered; the rule has the words of a shingle and the
    similarity, and a text of fewer words is one shingle. Sets without words (null and
    empty texts) are linked with nothing, their component is the document itself. Rows with a null doc_id link with
    nothing and have a null component; repeated rows are one set. Same doc_id with different texts: a row each.
    Linking is exact up to equal 48-bit hashes of different shingles in one pair.
    """
    return jaccard_rows(docs, rule).select("doc_id", "n_shingles", "component_id")
