"""Exact n-gram Jaccard join over whole texts, by a token-group matrix.

1. Every text becomes its set of word-shingle hashes; equal sets become one class. Shingles meet by hash in their partitions, which
   count in how many classes each occurs. A class of which more than a quarter of the shingles occur nowhere else links with
   nothing, so it is done.
2. The others are partitioned into groups of similar sets (by minimum hashes; large groups in chunks). Inside a chunk all overlaps
   come from one incidence matrix. The links found so far merge classes into components.
3. Every class is then in one unit: its component, or, without a link, its group of similar sets. The matrix of tokens and units holds each unit's
   rarest tokens; units meet where they share enough of them. A query's overlap with the union of a chunk's tokens bounds its
   overlap with every member: only qualifying chunks are opened and compared member by member.

Shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import blobs
from cohortspark.llm.common import mix, partitions, query, shingle_hashes, stored, table, text_chunks, whole_groups, word_hashes
from cohortspark.llm.components import components, spanning

WORDS = 5
PERCENT = 75
CHUNK = 128  #: members of one chunk of a group, about
SHARED = 4  #: rare tokens that two sets must share: prefixes are longer by as many less one
_FLUSH = 1_000_000


def _sets(column: pa.Array, n: int):
    """Distinct shingle hashes of each row, in ascending order."""
    words, offsets = word_hashes(column)
    hashes, bounds = shingle_hashes(words, offsets, n)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _name(s: np.ndarray) -> int:
    """A class's number: equal for equal sets, positive."""
    return int(mix(np.array([mix(s.copy()).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0] >> np.uint64(1))


def _shingles(docs: DataFrame, words: int, n: int) -> DataFrame:
    """Kind 0: shingles to their partitions; kind 1: classes to theirs; kind 2: which document is in which class."""

    def flush(sets: dict[int, np.ndarray], member: list):
        if sets:
            size = np.array([len(s) for s in sets.values()])
            name = np.repeat(np.array(list(sets), np.int64), size)
            token = np.concatenate(list(sets.values()))
            target = (token % np.uint64(n)).astype(np.int64)
            order = np.argsort(target, kind="stable")
            target, token, name = target[order], token[order], name[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1, [len(target)]])
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                first = np.concatenate([[0], np.flatnonzero(np.diff(name[a:b])) + 1])
                runs = blobs.packed([name[a:b][first], np.diff(np.concatenate([first, [b - a]])).astype(np.uint32)])
                out.append((int(target[a]), runs + blobs.packed([token[a:b]])))
            yield blobs.rows(0, out)
            names = np.array(list(sets), np.int64)
            yield blobs.rows(1, blobs.dealt(names % n, [names, size.astype(np.int64)]))
        if member:
            m = np.array(member, np.int64).reshape(-1, 3)
            yield blobs.rows(2, blobs.dealt((mix(m[:, 0].astype(np.uint64)) % np.uint64(n)).astype(np.int64), [m[:, 0], m[:, 1], m[:, 2]]))

    def run(batches):
        sets, member, held = {}, [], 0
        for batch in text_chunks(batches, "t", 1 << 20):
            for doc, s in zip(batch.column("k").to_pylist(), _sets(batch.column("t"), words), strict=True):
                name = _name(s) if len(s) else -1
                member.append((doc, name, len(s)))
                if len(s) and name not in sets:
                    sets[name] = s
                    held += len(s)
            if held >= _FLUSH:
                yield from filter(None, flush(sets, member))
                sets, member, held = {}, [], 0
        yield from filter(None, flush(sets, member))

    return docs.mapInArrow(run, blobs.SCHEMA)


def _common(shingles: DataFrame, n: int) -> DataFrame:
    """Kind 0: shingles of at least two classes, with their number of classes (255: or more), to the classes' partitions."""

    def run(batches):
        own = blobs.gathered(batches)
        for kind in (1, 2):
            for blob in own.get(kind, []):
                cols = blobs.unpacked(blob, ["i8"] * (kind + 1))
                where = cols[0] % n if kind == 1 else (mix(cols[0].astype(np.uint64)) % np.uint64(n)).astype(np.int64)
                yield blobs.rows(kind, [(int(where[0]), blob.to_pybytes())])
        names, tokens = [], []
        for blob in own.get(0, []):
            name, runs = blobs.unpacked(blob, ["i8", "u4"])
            names.append(np.repeat(name, runs))
            tokens.append(blobs.unpacked(memoryview(blob)[8 + 12 * len(name) :], ["u8"])[0])
        if not names:
            return
        name, token = np.concatenate(names), np.concatenate(tokens)
        # one class may come from several tasks
        order = np.lexsort((name, token))
        name, token = name[order], token[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        name, token = name[new], token[new]
        first = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1])
        count = np.diff(np.concatenate([first, [len(token)]]))
        df = np.repeat(count, count)
        m = df > 1
        yield blobs.rows(0, blobs.dealt(name[m] % n, [name[m], token[m], np.minimum(df[m], 255).astype(np.uint8)]))

    def live(batches):
        yield from filter(None, run(batches))

    return shingles.repartitionById(n, F.col("target")).mapInArrow(live, blobs.SCHEMA)


_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)  # fixed values: any two would do
_SURVIVOR = "doc long, name long, n long, tokens binary, prefix array<long>, " + ", ".join(f"g{i} long" for i in range(len(_SEEDS)))


def _survivors(common: DataFrame, n: int, percent: int, shared: int) -> DataFrame:
    """Documents with their classes (doc set), and the classes that may link with another (doc null) with their common shingles, rarest first."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * len(_SEEDS)]
    fields = [f.split()[0] for f in _SURVIVOR.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_pydict({f: pa.array(c, k) for f, k, c in zip(fields, kinds, zip(*rows, strict=True), strict=True)})

    def run(batches):
        own = blobs.gathered(batches)
        for blob in own.get(2, []):
            doc, name, size = blobs.unpacked(blob, ["i8"] * 3)
            none = [None] * len(doc)
            cols = [doc, np.where(name < 0, 0, name), size]
            yield pa.RecordBatch.from_pydict({f: pa.array(c if c is not none else none, k) for f, k, c in zip(fields, kinds, [*cols, *[none] * (len(fields) - 3)], strict=True)})
        name, size = blobs.joined(own.get(1, []), ["i8", "i8"])
        if not len(name):
            return
        name, at = np.unique(name, return_index=True)
        size = size[at]
        owner, token, df = blobs.joined(own.get(0, []), ["i8", "u8", "u1"])
        order = np.lexsort((token, df, owner))
        owner, token = owner[order], token[order]
        lo, hi = np.searchsorted(owner, name), np.searchsorted(owner, name, side="right")
        rows = []
        for i in np.flatnonzero((hi - lo) * 100 >= percent * size):
            t, total = token[lo[i] : hi[i]], int(size[i])
            need = -(-percent * total // 100)
            # the prefix of all shingles starts with those that no other class has
            prefix = t[: max(0, total - need + min(shared, need) - (total - len(t)))]
            rows.append((None, int(name[i]), total, t.tobytes(), prefix.astype(np.int64).tolist(), *[int(mix(t ^ np.uint64(x)).min() >> np.uint64(1)) for x in _SEEDS]))
            if len(rows) >= 2000:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return common.repartitionById(n, F.col("target")).mapInArrow(run, _SURVIVOR)


def _overlaps(one: list[np.ndarray], two: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, from the incidence matrices of both sides' tokens, a band of columns at a time."""
    union = np.unique(np.concatenate(one))
    out = np.zeros((len(one), len(two)), np.float32)

    def cells(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.searchsorted(union, flat)
        hit = union[np.minimum(at, len(union) - 1)] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    (r1, c1), (r2, c2) = cells(one), cells(two)
    for lo in range(0, len(union), columns):
        a, b = np.searchsorted(c1, [lo, lo + columns])
        c, d = np.searchsorted(c2, [lo, lo + columns])
        if a == b or c == d:
            continue
        m1, m2 = np.zeros((len(one), columns), np.float32), np.zeros((len(two), columns), np.float32)
        m1[r1[a:b], c1[a:b] - lo] = 1
        m2[r2[c:d], c2[c:d] - lo] = 1
        out += m1 @ m2.T
    return out


def _linked(one: list, n1: np.ndarray, two: list, n2: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    both = _overlaps(one, two).astype(np.int64)
    return np.nonzero((100 * both >= percent * (n1[:, None] + n2[None] - both)) & (both > 0))


def _groups(classes: DataFrame) -> DataFrame:
    """Columns (name, seed, gid, members): the group of similar sets that each class falls in, once for each grouping; large ones in chunks."""
    every = classes.select("name", F.posexplode(F.array(*[f"g{i}" for i in range(len(_SEEDS))])).alias("seed", "g"))
    sizes = every.groupBy("seed", "g").agg(F.count(F.lit(1)).alias("members"))
    chunk = F.pmod(F.xxhash64("name", "seed"), F.ceil(F.col("members") / CHUNK))
    return every.join(sizes, ["seed", "g"]).select("name", "seed", F.xxhash64("seed", "g", chunk).alias("gid"), "members")


_EDGE = "a long, b long"


def _edges(one: list, two: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(one) if one else [], pa.int64()), "b": pa.array(np.concatenate(two) if two else [], pa.int64())})


def _forest(i: np.ndarray, j: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as join what the links i, j join."""
    label = spanning(i, j, len(name))
    hit = np.flatnonzero(label != np.arange(len(name)))
    return name[hit], name[label[hit]]


def _tokens(column: pa.ChunkedArray, lo: int, hi: int) -> list[np.ndarray]:
    return [np.frombuffer(column[i].as_buffer(), np.uint64) for i in range(lo, hi)]


def _inside(classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span what is linked inside each chunk of each group; groups of one send nothing."""
    rows = groups.where("members > 1").select("name", "gid").join(classes.select("name", "n", "tokens"), "name")

    def run(batches):
        for own in whole_groups(batches, "gid", 1024):
            gid, name, size = (own[c].to_numpy() for c in ("gid", "name", "n"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(gid)) + 1, [len(gid)]])
            one, two = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                sets = _tokens(own["tokens"], lo, hi)
                i, j = _linked(sets, size[lo:hi], sets, size[lo:hi], percent)
                a, b = _forest(i, j, name[lo:hi])
                one.append(a)
                two.append(b)
            yield _edges(one, two)

    return rows.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, _EDGE)


def _across(classes: DataFrame, groups: DataFrame, roots: DataFrame, percent: int, shared: int) -> DataFrame:
    """Edges (a, b) between the classes of different units that link: a component found so far, or a group of similar classes without a link.

    Both kinds travel in chunks (gid). Units meet by the token-group matrix, then the union of a chunk's tokens bounds each query's overlap.
    """
    root = roots.select(F.col("node").alias("name"), "root")
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("linked"))
    place = groups.where("seed = 0").select("name", "gid").join(root, "name", "left").join(sizes, "root", "left")
    chunk = F.xxhash64("root", F.pmod(F.xxhash64("name"), F.ceil(F.col("linked") / CHUNK)))
    place = place.select("name", F.coalesce("root", "gid").alias("unit"), F.when(F.col("root").isNull(), F.col("gid")).otherwise(chunk).alias("gid"))
    place, _ = stored(place.join(classes.select("name", "n"), "name"))
    # the token-group matrix: each unit's rare tokens, with the sizes of the sets that have them; tokens of one unit alone lead nowhere
    cells = classes.select("name", F.explode("prefix").alias("token")).join(place, "name")
    cells = cells.groupBy("token", "unit").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    several = cells.groupBy("token").agg(F.min("unit").alias("u1"), F.max("unit").alias("u2")).where("u1 <> u2").select("token")
    cells, _ = stored(cells.join(several, "token", "left_semi"))
    x, y = cells.alias("x"), cells.alias("y")
    fits = lambda a, b: (F.col(f"{a}.most") * 100 >= F.col(f"{b}.least") * percent) & (F.col(f"{b}.most") * 100 >= F.col(f"{a}.least") * percent)
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.unit") < F.col("y.unit")) & fits("x", "y"))
    met = met.groupBy(F.col("x.unit").alias("u1"), F.col("y.unit").alias("u2")).agg(F.count(F.lit(1)).alias("k"), F.min(F.least("x.least", "y.least")).alias("least"))
    # two sets that link share the first of their common tokens in both prefixes, `shared` of them or all that they need
    pairs = met.where(F.col("k") >= F.least(F.lit(shared), F.ceil(F.col("least") * percent / 100))).select("u1", "u2")
    chunks = place.groupBy("unit", "gid").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("size"))
    x, y = chunks.alias("x"), chunks.alias("y")
    met = pairs.join(x, F.col("u1") == F.col("x.unit")).join(y, F.col("u2") == F.col("y.unit")).where(fits("x", "y"))
    # the smaller chunk travels to the larger one, which is dealt to several hosts where many come
    larger = F.col("x.size") >= F.col("y.size")
    hosts, _ = stored(met.select(F.when(larger, F.col("x.gid")).otherwise(F.col("y.gid")).alias("g1"), F.when(larger, F.col("y.gid")).otherwise(F.col("x.gid")).alias("g2")))
    many = hosts.groupBy("g1").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CHUNK)
    hosts = hosts.join(many, "g1", "left").select("g1", "g2", F.xxhash64("g1", F.pmod("g2", F.ceil(F.coalesce("c", F.lit(1)) / CHUNK))).alias("host"))
    home = hosts.select("host", F.col("g1").alias("gid"), F.lit(0).alias("query")).distinct()
    trips = home.unionAll(hosts.select("host", F.col("g2").alias("gid"), F.lit(1)))
    rows = trips.join(place.select("gid", "name"), "gid").join(classes.select("name", "n", "tokens"), "name")

    def run(batches):
        for own in whole_groups(batches, "host", 1024):
            host, query_, name, size = (own[c].to_numpy() for c in ("host", "query", "name", "n"))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(host)) + 1, [len(host)]])
            one, two = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                mid = hi - int(query_[lo:hi].sum())
                members = _tokens(own["tokens"], lo, mid)
                for at in range(mid, hi, CHUNK):
                    to = min(hi, at + CHUNK)
                    queries = _tokens(own["tokens"], at, to)
                    opened = qualifying(members, queries, size[at:to], percent)
                    if not len(opened):
                        continue
                    i, j = _linked(members, size[lo:mid], [queries[k] for k in opened], size[at:to][opened], percent)
                    a, b = _forest(i, mid - lo + j, np.concatenate([name[lo:mid], name[at:to][opened]]))
                    one.append(a)
                    two.append(b)
            yield _edges(one, two)

    return rows.repartition("host").sortWithinPartitions("host", "query").mapInArrow(run, _EDGE)


def qualifying(members: list, queries: list, size: np.ndarray, percent: int) -> np.ndarray:
    """The queries that open a group: the union of its members' tokens bounds a query's overlap with each of them."""
    union = np.unique(np.concatenate(members))
    bound = np.array([np.isin(q, union, assume_unique=True).sum() for q in queries])
    return np.flatnonzero(100 * bound >= percent * size)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, parts: int | None = None) -> DataFrame:
    """Columns (key, n_shingles, component_id): each document's number of distinct shingles and the smallest key it is linked to, itself included.

    Two documents link when 100 * intersection >= percent * union of their shingle sets. A text of fewer words has one shingle of all its words; null, empty and white
    texts have none and link with nothing. Equal sets link. Rows that repeat a key come out as often. Rows with a null key link with nothing and have a null component. An empty table gives no rows.
    """
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{key} must be a whole number, not {dict(docs.dtypes)[key]}")
    n = parts or partitions(docs.sparkSession)
    every = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = every.where("k is not null")
    both, _ = stored(_survivors(_common(_shingles(rows, words, n), n), n, percent, SHARED))
    member = both.where("doc is not null").select(F.col("doc").alias("doc_id"), "name", F.col("n").alias("n_shingles"))
    classes = both.where("doc is null").drop("doc")
    groups, _ = stored(_groups(classes))
    near, _ = stored(_inside(classes, groups, percent))
    roots = components(near)
    far, seen = stored(_across(classes, groups, roots, percent, SHARED), n=F.count(F.lit(1)))
    if seen["n"]:
        roots = components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(far))
    named = member.where("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("first"))
    named = named.join(roots.select(F.col("node").alias("name"), "root"), "name", "left")
    named, _ = stored(named.select("name", "first", F.coalesce("root", "name").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = named.join(least, "root").select("name", "component_id")
    out = member.join(label, "name", "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select(F.col("doc_id").alias(key), "n_shingles", linked.alias("component_id"))

    def sizes(batches):
        for batch in text_chunks(batches, "t", 1 << 20):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(s) for s in _sets(batch.column("t"), words)], pa.int64())})

    no_key = every.where("k is null").mapInArrow(sizes, "n long")
    return out.unionAll(no_key.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))


@query("op4_ngram_join")
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
