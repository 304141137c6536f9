"""Nearest vocabulary terms by matching blocks of characters or by an encoder's vectors."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.vectors import unit

BLOCK = 4096  #: terms of one block of the vocabulary
HELD = 64 << 20  #: bytes of a vocabulary that goes with the tasks; a larger one is visited block by block


def block_ratio(a: str, b: str) -> float:
    """2 m / (length of both): m characters lie in the longest common block and, on either side of it, in further ones."""
    return SequenceMatcher(None, a, b).ratio()


def _counts(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(alphabet) + 1), np.int16)
    for i, t in enumerate(texts):
        for c in t:
            out[i, alphabet.get(c, len(alphabet))] += 1
    return out


def _block_scores(tokens: list[str], terms: list[str], least: float) -> tuple[list[float], list[int]]:
    """Score and place of each token's best term of at least `least`, ties by place; (-1, -1) without any.

    Characters that both have bound what blocks can match. Terms come in the order of their bound and the rest is skipped once a bound is under the best ratio.
    """
    alphabet = {c: i for i, c in enumerate(sorted({c for t in terms for c in t}))}
    have, sizes = _counts(terms, alphabet)[:, :-1], np.array([len(t) for t in terms])
    scores, places = [], []
    for token, counts in zip(tokens, _counts(tokens, alphabet)[:, :-1], strict=True):
        used = np.flatnonzero(counts)
        shared = np.minimum(have[:, used], counts[used]).sum(axis=1)
        bound = 2 * shared / np.maximum(sizes + len(token), 1)
        best, at = least, -1
        order = np.flatnonzero(bound >= least)
        for i in order[np.argsort(-bound[order], kind="stable")]:
            if bound[i] < best:
                break
            r = block_ratio(token, terms[i])
            if r > best or (r >= best and (at < 0 or i < at)):
                best, at = r, int(i)
        scores.append(best if at >= 0 else -1.0), places.append(at)
    return scores, places


def _vector_scores(encode, matrix: np.ndarray, tokens: list[str], least: float) -> tuple[list[float], list[int]]:
    """The same by cosine of encoded tokens with unit rows, to nine digits."""
    cos = np.round(unit(np.array(encode(tokens), np.float64).reshape(len(tokens), matrix.shape[1])) @ matrix.T, 9)
    cos = np.where(np.isnan(cos), -2.0, cos)
    at = np.argmax(cos, axis=1)
    best = cos[np.arange(len(tokens)), at]
    return np.where(best >= least, best, -1.0).tolist(), np.where(best >= least, at, -1).tolist()


def _matched(tokens: DataFrame, vocab: DataFrame, scorer: Callable[[list[str]], Callable[[list[str]], tuple[list[float], list[int]]]], width: int) -> DataFrame:
    """(token, match, score, status) of the distinct tokens. scorer(terms) is made once for each sorted block of terms and scores batches of tokens."""
    spark = tokens.sparkSession
    asked = tokens.select("token").where(F.col("token").isNotNull()).distinct()
    terms = vocab.select("term").where(F.col("term").isNotNull()).distinct()
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term") + width).alias("b")).first()
    schema = "token string, term string, score double"

    def rows(batch_tokens, block, ready):
        scores, places = ready(batch_tokens) if block and batch_tokens else ([-1.0] * len(batch_tokens), [-1] * len(batch_tokens))
        return {"token": pa.array(batch_tokens, pa.string()), "term": pa.array([block[i] if i >= 0 else None for i in places], pa.string()), "score": pa.array(scores, pa.float64())}

    if (size["b"] or 0) <= HELD:
        block = sorted(r["term"] for r in terms.collect())  # of a checked size

        def run(batches):
            ready = scorer(block) if block else None
            for batch in batches:
                yield pa.RecordBatch.from_pydict(rows(batch.column("token").to_pylist(), block, ready))

        best = asked.mapInArrow(run, schema)
    else:
        blocks = -(-size["n"] // BLOCK)
        sides = max(1, -(-asked.count() // BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        t = asked.select("token", place("token", sides).alias("i"), every(blocks).alias("j"))
        v = terms.select("term", place("term", blocks).alias("j"), every(sides).alias("i"))

        def tile(left: pa.Table, right: pa.Table) -> pa.Table:
            block = sorted(right["term"].to_pylist())
            return pa.table(rows(left["token"].to_pylist(), block, scorer(block) if block else None))

        best = t.groupBy("i", "j").cogroup(v.groupBy("i", "j")).applyInArrow(tile, schema)
    one = best.where("term is not null").groupBy("token").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("x"))
    out = asked.join(terms.withColumnRenamed("term", "_own"), F.col("token") == F.col("_own"), "left").join(one, "token", "left")
    exact = F.col("_own").isNotNull()
    score = F.when(exact, 1.0).otherwise(F.round(-F.col("x.s"), 9))
    status = F.when(exact, "exact").when(F.col("x.s").isNotNull(), "nearest").otherwise("kept_original")
    return out.select("token", F.when(exact, F.col("token")).otherwise(F.coalesce("x.term", "token")).alias("match"), score.alias("score"), status.alias("status"))


def nearest_blocks(tokens: DataFrame, vocab: DataFrame, least: float = 0.86) -> DataFrame:
    """Each distinct token with the term of the greatest matching-block ratio, ties by term; kept as it is below `least`. Null tokens and terms are left out."""
    return _matched(tokens, vocab, lambda terms: lambda some: _block_scores(some, terms, least), 16)


def nearest_vectors(tokens: DataFrame, vocab: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], size: int, least: float = 0.86) -> DataFrame:
    """Each distinct token with the term whose encoded vector of `size` numbers has the greatest cosine, to nine digits, ties by term; kept as it is below `least`.

    A block of terms is one packed matrix, and a batch of tokens meets it in one product. A text of zero length as a vector is near nothing.
    """

    def scorer(terms: list[str]):
        encode = encoder()
        matrix = unit(np.array(encode(terms), np.float64).reshape(len(terms), size))
        return lambda some: _vector_scores(encode, matrix, some, least)

    return _matched(tokens, vocab, scorer, 8 * size)
