"""Collocations by prefix-free parsing: n-grams are counted in the distinct chunks of the corpus, weighted by how often each chunk occurs.

A chunk starts at a document's first word and wherever the hash of three consecutive words hits a trigger, so equal passages are cut
alike wherever they stand. It owns the words up to the next start and carries up to three words of the next chunk: a
phrase belongs to the chunk that owns its first word, and is counted once. Phrases of n words are looked for where both their parts of n - 1 words are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import flat_bytes, mix, prefix_sums, query, span_hashes, stored, table, text_chunks

LONGEST = 4  #: words of the longest phrase
TRIGGER = 16  #: about so many words lie between two chunk starts; a power of two
FILTER_BITS = 1 << 27  #: most bits of the filter of frequent phrases (16 MB)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_SPACE, _STOP = 32, 46


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes [start, end) of each span as strings."""
    n = end - start
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], n)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def chunks(column: pa.Array, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, number of owned words and text of every chunk of the rows' texts, each of which ends with a line break.

    In a chunk's text words are parted by a space, or by a full stop where a piece ends between them.
    """
    data, offsets = flat_bytes(column)
    data = _LOWER[data]
    word = np.concatenate([[False], _WORD[data]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    row = np.searchsorted(offsets, starts, side="right") - 1
    last = np.concatenate([row[1:] != row[:-1], [True]])
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    stop = last | (breaks[np.concatenate([starts[1:], starts[-1:]])] > breaks[ends])
    keep = word[1:] | word[:-1]  # each word and the byte after it
    upto = np.concatenate([[0], np.cumsum(keep)])
    data, starts, ends = data[keep], upto[starts], upto[ends]
    data[ends] = np.where(stop, _STOP, _SPACE)
    h = np.concatenate([span_hashes(prefix_sums(data), starts, ends), np.zeros(2, np.uint64)])
    n = len(starts)
    hit = (mix(h[:n] + np.uint64(3) * h[1 : n + 1] + np.uint64(5) * h[2:]) & np.uint64(trigger - 1)) == 0
    within = np.zeros(n, bool)
    within[: n - 2] = row[: n - 2] == row[2:]
    first = np.flatnonzero((hit & within) | np.concatenate([[True], last[:-1]]))
    after = np.concatenate([first[1:], [n]])  # one beyond the last owned word
    tail = after - 1
    for _ in range(LONGEST - 1):
        tail = np.where(stop[tail], tail, tail + 1)
    return row[first], (after - first).astype(np.int32), _spans(data, starts[first], ends[tail])


class _Words:
    """The words of chunk (or phrase) texts of one batch: their place, number and hash, and whether the next one follows in the same piece."""

    def __init__(self, column: pa.Array):
        self.data, offsets = flat_bytes(column)
        cut = (self.data == _SPACE) | (self.data == _STOP)
        per = np.add.reduceat(np.concatenate([cut, [0]]).astype(np.int64), offsets[:-1]) + 1 if len(offsets) > 1 else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(per)), per)
        self.first = np.concatenate([[0], np.cumsum(per)])
        at = np.flatnonzero(cut)
        self.start = np.sort(np.concatenate([offsets[:-1], at + 1]))
        self.end = np.sort(np.concatenate([offsets[1:], at]))
        inside = self.end < offsets[1:][self.row]
        self.joined = np.zeros(len(self.end), bool)
        self.joined[inside] = self.data[self.end[inside]] == _SPACE
        sizes = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(self.end), [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(self.data[~cut]))]).dictionary_encode()
        self.id = coded.indices.to_numpy().astype(np.int64)
        self.distinct = len(coded.dictionary)
        data, offsets = flat_bytes(coded.dictionary)
        self.hash = span_hashes(prefix_sums(data), offsets[:-1], offsets[1:])[self.id]


def _hashes(words: _Words, at: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of n words that start at the given words."""
    total = mix(lang[words.row[at]].copy())
    for k in range(n):
        total += mix(words.hash[at + k] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return mix(total)


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    data, offsets = flat_bytes(coded.dictionary)
    ids = coded.indices.to_numpy().astype(np.int64)
    return ids, coded.dictionary, span_hashes(prefix_sums(data), offsets[:-1], offsets[1:])[ids]


def _held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """The rows in tables of about `most` bytes of text."""
    held, size = [], 0
    for batch in text_chunks(batches, column, most, 1_000_000):
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(rows: pa.Table, name: str) -> pa.Array:
    return rows[name].chunk(0)


def _counted(parsed: DataFrame, n: int, bits) -> DataFrame:
    """Occurrences of phrases of n words as (lang, phrase, c), summed inside each batch; bits: the filter of frequent phrases of n - 1 words."""

    def count(batches):
        for rows in _slices(batches, "chunk", 4 << 20):
            words = _Words(_one(rows, "chunk"))
            lang, names, lang_hash = _languages(_one(rows, "lang"))
            own, m = _one(rows, "own").to_numpy(), _one(rows, "m").to_numpy()
            ok = np.arange(len(words.row)) - words.first[:-1][words.row] < own[words.row]
            for k in range(n - 1):
                ok[: len(ok) - k] &= words.joined[k:]
                ok[len(ok) - k :] = False
            at = np.flatnonzero(ok)
            if n > 1:
                at = at[_held(bits.value, _hashes(words, at, n - 1, lang_hash))]
                at = at[_held(bits.value, _hashes(words, at + 1, n - 1, lang_hash))]
            if not len(at):
                continue
            key = lang[words.row[at]]
            for k in range(n):  # phrases numbered word by word: exact, and under 2^63
                key = np.unique(key, return_inverse=True)[1] * words.distinct + words.id[at + k]
            order = np.argsort(key, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1])
            one = at[order[cuts]]
            c = np.add.reduceat(m[words.row[at]][order], cuts)
            yield pa.RecordBatch.from_pydict({"lang": names.take(pa.array(lang[words.row[one]])), "phrase": _spans(words.data, words.start[one], words.end[one + n - 1]), "c": pa.array(c, pa.int64())})

    return parsed.mapInArrow(count, "lang string, phrase string, c long")


def _filter(frequent: DataFrame, n: int, rows: int) -> np.ndarray:
    """A bit per hash of the frequent phrases. It lets every one of them pass, and few others while it has 16 bits for each; counts don't depend on it."""
    size = min(FILTER_BITS, max(1 << 12, 1 << (16 * rows).bit_length()))

    def marks(batches):
        for rows in _slices(batches, "phrase", 4 << 20):
            words = _Words(_one(rows, "phrase"))
            at = _hashes(words, words.first[:-1], n, _languages(_one(rows, "lang"))[2]) & np.uint64(size - 1)
            yield pa.RecordBatch.from_pydict({"w": pa.array((at >> np.uint64(6)).astype(np.int64)), "b": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    made = frequent.select("lang", "phrase").mapInArrow(marks, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(size // 64, np.uint64)
    bits[made["w"].to_numpy()] = made["b"].to_numpy().view(np.uint64)
    return bits


def parse(docs: DataFrame, text: str = "text", lang: str = "lang", trigger: int = TRIGGER) -> DataFrame:
    """The dictionary of the parse: (lang, own, chunk, m), one row per distinct chunk with its number of occurrences."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("t"))

    def cut(batches):
        for batch in text_chunks(batches, "t", 4 << 20):
            row, own, chunk = chunks(batch.column("t"), trigger)
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").take(pa.array(row)), "own": pa.array(own, pa.int32()), "chunk": chunk})

    return rows.mapInArrow(cut, "lang string, own int, chunk string").groupBy("lang", "own", "chunk").agg(F.count(F.lit(1)).alias("m"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """The first `most` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; pieces end at . , ; : ! ? and line breaks, words at spaces and tabs. a, l and r count all occurrences of the phrase and of both parts of its
    worst cut, n the language's words; score is floor(2000000 a / (l + r)). Phrases under `least` occurrences, and those inside a longer one with `covered` per cent of
    their occurrences, are left out. Null and empty texts have no words, a null language is `und`; a very long text is cut into chunks like any
    other; repeated rows count as often as they stand; ties go by a, then by the phrase's bytes. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    parsed, _ = stored(parse(docs, text, lang))
    levels, bits = [], None
    for n in range(1, LONGEST + 1):
        counted = _counted(parsed, n, bits).groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        level, seen = stored(counted, rows=F.count(F.lit(1)))
        levels.append(level)
        if n < LONGEST:
            bits = spark.sparkContext.broadcast(_filter(level, n, seen["rows"]))
    return _scored(parsed, levels, most, covered)


def _scored(parsed: DataFrame, levels: list[DataFrame], most: int, covered: int) -> DataFrame:
    sizes = parsed.groupBy("lang").agg(F.sum(F.col("own") * F.col("m")).alias("n"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionAll(union(frames[1:]))
    words = lambda: F.split("phrase", " ")
    run = lambda at, size: F.array_join(F.slice(words(), at, size), " ")
    inner = []
    for n in range(3, LONGEST + 1):
        for size in range(2, n):
            for at in range(1, n - size + 2):
                inner.append(levels[n - 1].select("lang", run(at, size).alias("phrase"), F.col("f").alias("over")))
    over = union(inner).groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    candidates = union(levels[1:]).join(over, ["lang", "phrase"], "left")
    kept = candidates.where(F.col("over").isNull() | (F.col("over").cast("decimal(24,0)") * 100 < F.col("f").cast("decimal(24,0)") * covered))
    cut = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words()) - 1)).alias("k"))
    cut = cut.withColumns({"_first": run(1, F.col("k")), "_rest": run(F.col("k") + 1, LONGEST)})
    shorter = union(levels[:-1])
    left, right = (shorter.select(F.col("lang").alias(f"_g{c}"), F.col("phrase").alias(f"_p{c}"), F.col("f").alias(c)) for c in ("l", "r"))
    cut = cut.join(left, (F.col("lang") == F.col("_gl")) & (F.col("_first") == F.col("_pl"))).join(right, (F.col("lang") == F.col("_gr")) & (F.col("_rest") == F.col("_pr")))
    cut = cut.withColumn("score", F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    worst = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("lang", "phrase", "a", "w.l", "w.r", "w.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)  # the last window gets 64 times `most` rows of a language at most
    best = worst.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= most).drop("_n")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^ \t]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM s, range(1, 5) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE f >= 30 AND k > 1),
inner_of AS (SELECT c.lang, array_to_string(ws[b : b + size - 1], ' ') AS phrase, max(f) AS most FROM c, range(2, 4) AS t1(size), range(1, 4) AS t2(b) WHERE size < k AND b + size - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_of AS o USING (lang, phrase) WHERE o.most IS NULL OR 100 * CAST(o.most AS HUGEINT) < 80 * CAST(c.f AS HUGEINT)),
cut AS (SELECT q.lang, q.phrase, q.f AS a, j, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * q.f) // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM kept) AS q
  JOIN f AS l ON l.lang = q.lang AND l.phrase = array_to_string(q.ws[1 : j], ' ') JOIN f AS r ON r.lang = q.lang AND r.phrase = array_to_string(q.ws[j + 1 : q.k], ' ')),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best JOIN n USING (lang) WHERE rank <= 2000"""


@query("op11_collocations", _SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
