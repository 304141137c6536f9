"""Exact removal of repeated substrings, by longest-previous-factor arrays over anchored pieces.

Every window of `LENGTH` bytes has one anchor: its k-gram of the smallest hash. Equal windows have equal anchors at equal distances,
so only pieces (the windows round one place of an anchor) with the same anchor can match: a group of such pieces is a small text of its
own. Its suffixes are put in suffix order with their common prefixes, and the previous and next smaller positions in that order give
each suffix's longest previous factor. A window goes where that factor has LENGTH bytes or more; nothing else removes any.

1. Each task lays the pieces of its texts, and removes what its own earlier texts hold, by the same arrays: copies don't travel.
2. Pieces go to their anchors' groups without bytes. A group of one piece has no match.
3. The others get their bytes from the texts and meet again by group, where the arrays give spans.
4. Spans go to their documents.

An anchor that many documents have (a common line) sends narrower pieces, each keyed by all the bytes that its windows share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.llm.common import flat_bytes, mix, prefix_sums, query, span_hashes, stored, table, text_chunks, whole_groups

LENGTH = 100  #: bytes that must repeat
_GRAM = 32
_REACH = LENGTH - _GRAM  # of an anchor inside its window
_WIDTH = _REACH + LENGTH  # of all windows that an anchor can have
_NARROW = 9  # distances to a narrow piece
_SLAB = 30_000  # pieces whose arrays are built at once; a group stays whole
_LOCAL = 4 << 20  # bytes of text that a task searches for its own repeats at once

_PIECE = "g long, doc long, start int, more int, lead int"
_SPAN = "doc long, start int, end int"


def anchors(data: np.ndarray, offsets: np.ndarray):
    """For each run of windows with one anchor: document number, first window, further windows, anchor; also the anchors' hashes and prefix sums."""
    sums = prefix_sums(data)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64), sums
    at = np.arange(len(data) - _GRAM + 1)
    gram = span_hashes(sums, at, at + _GRAM)
    low = (gram >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= _REACH + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data) - LENGTH + 1], low[_REACH + 1 - width :][: len(data) - LENGTH + 1])
    lengths = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int64)
    long = lengths >= LENGTH
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    windows = np.flatnonzero(np.cumsum(valid)[: len(low)])
    if not len(windows):
        return none, none, none, none, np.zeros(0, np.uint64), sums
    anchor = (low[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    start, more = windows[first], windows[last] - windows[first]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return doc, start, more, anchor[first], gram[anchor[first]], sums


def aligned(data: np.ndarray, at: np.ndarray, more: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """One row of bytes per piece, with its anchor in column _REACH and zeros where the piece has no bytes; `at`: where it starts in data."""
    size = more + LENGTH
    upto = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(upto, size)
    out = np.zeros(len(at) * _WIDTH, np.uint8)
    to = np.repeat(np.arange(len(at)) * _WIDTH + _REACH - lead, size) + step
    out[to] = data[np.repeat(at, size) + step]
    return out.reshape(-1, _WIDTH)


def _smaller_before(place: np.ndarray, lcp: np.ndarray, todo: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix of `todo` with the nearest one before it in suffix order that has a smaller place.

    Below LENGTH it isn't followed further. Entries jump over each other's known ranges, so that runs of larger places take few rounds.
    """
    near, common = np.arange(len(lcp)) - 1, lcp.copy()
    todo = todo[common[todo] >= LENGTH]
    while len(todo):
        todo = todo[place[near[todo]] >= place[todo]]
        by = near[todo]
        common[todo] = np.minimum(common[todo], common[by])
        near[todo] = near[by]
        todo = todo[common[todo] >= LENGTH]
    return common


def previous_factors(group: np.ndarray, place: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lengths of the longest previous factors: one row per piece, one column per distance (0 to _REACH) that a suffix starts before the anchor.

    `group`: ascending numbers of the pieces' groups; `place`: the order of the pieces in the corpus (equal: the same place); `rows`: their
    bytes as aligned() gives them; a piece's own suffixes are those at distances first to last. Lengths under LENGTH are not exact, and 0 stands
    for suffixes that a piece doesn't have.

    The suffixes at distance 0 are sorted; those one byte longer take their order from that byte and the order before (induced sorting), and their
    common prefixes from the least one between them. Windows at different distances never match, so each distance has an array of its own.
    """
    n = len(group)
    out = np.zeros((n, _REACH + 1), np.int16)
    if n < 2:
        return out
    _, number = np.unique(group, return_inverse=True)
    number = number.astype(np.uint16 if number[-1] < 1 << 16 else np.int64)
    right = rows[:, _REACH:]
    key = np.ascontiguousarray(np.concatenate([number.astype(">u8").view(np.uint8).reshape(n, 8), right], axis=1))
    order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
    g, sorted_rows = number[order], right[order]
    differs = sorted_rows[1:] != sorted_rows[:-1]
    lcp = np.zeros(n, np.int16)
    lcp[1:] = np.where(g[1:] == g[:-1], np.where(differs.any(1), differs.argmax(1), LENGTH), 0)
    for d in range(_REACH + 1):
        if d:
            byte = rows[order, _REACH - d]
            by = np.argsort(byte, kind="stable")
            by = by[np.argsort(g[by], kind="stable")]
            least = np.minimum.reduceat(np.append(lcp, np.int16(0)), by + 1)[:-1]
            order, byte, g = order[by], byte[by], g[by]
            lcp = np.zeros(n, np.int16)
            lcp[1:] = np.where((g[1:] == g[:-1]) & (byte[1:] == byte[:-1]), least + 1, 0)
        if not (lcp >= LENGTH).any():
            continue
        own = np.flatnonzero(((first <= d) & (d <= last))[order])
        if len(own) < 2:
            continue
        # the array of this distance: own suffixes only, and of them those with a neighbour that is LENGTH bytes alike
        common = np.append(np.int16(0), np.minimum.reduceat(np.append(lcp, np.int16(0)), own + 1)[:-1])
        live = common >= LENGTH
        live[:-1] |= live[1:]
        own, common = own[live], common[live]
        here, every = place[order[own]], np.arange(len(own))
        before = _smaller_before(here, common, every)
        # a whole suffix found before can't be longer after
        rest = len(own) - 1 - np.flatnonzero(before < LENGTH + d)
        after = _smaller_before(here[::-1], np.append(np.int16(0), common[:0:-1]), rest)[::-1]
        out[order[own], d] = np.where(before < LENGTH + d, np.maximum(before, after), before)
    return out


def _repeats(group, doc, anchor, lead, more, rows_of) -> np.ndarray:
    """Of each piece (row) and distance (column), whether its window repeats an earlier one; pieces ascend by group."""
    hit = np.zeros((len(group), _REACH + 1), bool)
    ends = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    lo = 0
    while lo < len(group):
        # whole groups, up to a slab of pieces
        hi = int(ends[max(0, np.searchsorted(ends, lo + _SLAB, side="right") - 1)])
        if hi <= lo:
            hi = int(ends[np.searchsorted(ends, lo, side="right")])
        part = slice(lo, hi)
        by = np.lexsort((anchor[part], doc[part], group[part]))
        g, d, a, near, far = group[part][by], doc[part][by], anchor[part][by], (lead - more)[part][by], lead[part][by]
        # places count within groups, which never meet
        place = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1])]))
        hit[np.arange(lo, hi)[by]] = previous_factors(g, place, rows_of(part)[by], near, far) >= LENGTH
        lo = hi
    return hit


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of each document, with overlapping and adjacent ones made one."""
    if not len(doc):
        return [doc, start, end]
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.ones(len(doc), bool)
    # ends of a document's earlier spans: a running maximum, apart for each document
    rank = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
    lift = np.int64(end.max() + 1)
    reach = np.maximum.accumulate(end + rank * lift) - rank * lift
    fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    return [doc[at], start[at], np.maximum.reduceat(end, at)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of True."""
    edge = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    edge[:, 1:-1] = mask
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def _batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_pydict({name: pa.array(c.astype(np.int64), kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def hot_anchors(docs: DataFrame, share: int = 64, least: int = 16, part: float = 0.001) -> np.ndarray:
    """Anchors in at least `least` and a thousandth of a sample of documents: only how they travel depends on it, no result does.

    Documents have some hundreds of anchors, so fewer than some hundred thousand can reach that share, whatever the corpus.
    """
    sample = docs.where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0)
    total = sample.count()

    def run(batches):
        for batch in text_chunks(batches, "t", 1 << 20):
            doc, _, _, _, hashes, _ = anchors(*flat_bytes(batch.column("t")))
            pairs = np.unique(np.stack([doc.astype(np.uint64), hashes], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
            h, n = np.unique(pairs[:, 1], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= max(least, part * total))
    return np.sort(np.array([r["h"] for r in most.select("h").collect()], np.int64).astype(np.uint64))


def _narrowed(start, more, lead, sums, at):
    """Each piece cut at fixed distances from its anchor: which piece, first window, further windows, anchor's offset, and the hash of the shared bytes."""
    which, first, last, low, high = [], [], [], [], []
    for lo in range(0, _REACH + 1, _NARROW):
        hi = min(lo + _NARROW - 1, _REACH)
        far, close = np.minimum(lead, hi), np.maximum(lead - more, lo)
        own = np.flatnonzero(far >= close)
        which.append(own)
        first.append(far[own])
        last.append(close[own])
        low.append(np.full(len(own), lo))
        high.append(np.full(len(own), hi))
    which, far, close, lo, hi = (np.concatenate(x) for x in (which, first, last, low, high))
    anchor = at[which] + lead[which]
    shared = span_hashes(sums, anchor - lo, anchor + LENGTH - hi)
    return which, start[which] + lead[which] - far, far - close, far, mix(shared + lo.astype(np.uint64))


def _pieces(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """Pieces without bytes, and spans of the windows that repeat one of the same task (g null, more: the span's end)."""

    def flush(held):
        data = np.concatenate([h[0] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held])[:-1]
        at = np.concatenate([h[1] + b for h, b in zip(held, base, strict=True)])
        key, doc, start, more, lead = (np.concatenate(x) for x in list(zip(*held, strict=True))[2:])
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = np.zeros(len(k), bool)
        again[1:] = k[1:] == k[:-1]
        again[:-1] |= again[1:]
        several, single = order[again], order[~again]
        windows = [(single, start[single], more[single], lead[single])]
        if len(several):
            rows = lambda part: aligned(data, at[several[part]], more[several[part]], lead[several[part]])
            hit = _repeats(key[several], doc[several], start[several] + lead[several], lead[several], more[several], rows)
            row, close, far = _runs(hit)
            s = start[several[row]] + lead[several[row]] - far
            d, s, e = _merged(doc[several[row]], s, s + far - close + LENGTH)
            yield pa.RecordBatch.from_pydict({"g": pa.nulls(len(d), pa.int64()), "doc": d, "start": pa.array(s, pa.int32()), "more": pa.array(e, pa.int32()), "lead": pa.array(np.zeros(len(d)), pa.int32())})
            distance = np.arange(_REACH + 1)
            own = (distance >= (lead - more)[several, None]) & (distance <= lead[several, None]) & ~hit
            row, close, far = _runs(own)
            p = several[row]
            windows.append((p, start[p] + lead[p] - far, far - close, far))
        which, start2, more2, lead2 = (np.concatenate(x) for x in zip(*windows, strict=True))
        is_hot = np.isin(key[which], hot) if len(hot) else np.zeros(len(which), bool)
        calm = which[~is_hot]
        yield _batch(_PIECE, [key[calm], doc[calm], start2[~is_hot], more2[~is_hot], lead2[~is_hot]])
        if is_hot.any():
            w, s, m, le = which[is_hot], start2[is_hot], more2[is_hot], lead2[is_hot]
            own, s, m, le, g = _narrowed(s, m, le, prefix_sums(data), at[w] + s - start[w])
            yield _batch(_PIECE, [g, doc[w[own]], s, m, le])

    def run(batches):
        held, size = [], 0
        for batch in text_chunks(batches, "t", 1 << 20):
            data, offsets = flat_bytes(batch.column("t"))
            ids = batch.column("k").to_numpy(zero_copy_only=False).astype(np.int64)
            doc, start, more, anchor, hashes, _ = anchors(data, offsets)
            held.append((data.copy(), start, hashes, ids[doc], start - offsets[doc], more, anchor - start))
            size += len(data)
            if size >= _LOCAL:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return docs.mapInArrow(run, _PIECE)


def _match(pieces: DataFrame) -> DataFrame:
    """Spans of the windows that repeat earlier ones; pieces come with their bytes, sorted by group."""

    def spans(own: pa.Table):
        g, doc, start, more, lead = (own[c].to_numpy().astype(np.int64) for c in ("g", "doc", "start", "more", "lead"))
        data, offsets = flat_bytes(own["b"].combine_chunks())
        # bytes are short only where a key repeats with a shorter text: such a piece has no window there
        whole = np.flatnonzero(np.diff(offsets) == more + LENGTH)
        g, doc, start, more, lead, at = (x[whole] for x in (g, doc, start, more, lead, offsets[:-1]))
        rows = lambda part: aligned(data, at[part], more[part], lead[part])
        row, close, far = _runs(_repeats(g, doc, start + lead, lead, more, rows))
        s = start[row] + lead[row] - far
        return _batch(_SPAN, _merged(doc[row], s, s + far - close + LENGTH))

    def run(batches):
        for own in whole_groups(batches, "g", _SLAB):
            yield spans(own)

    return pieces.repartition("g").sortWithinPartitions("g").mapInArrow(run, _SPAN)


def _finish(rows: DataFrame, clean: bool) -> DataFrame:
    """The texts `t` without their spans `s`."""

    def run(batches):
        for batch in text_chunks(batches, "t", 4 << 20):
            data, offsets = flat_bytes(batch.column("t"))
            ids = batch.column("k").to_pylist()
            spans = batch.column("s")
            n = np.diff(spans.offsets.to_numpy())
            flat = spans.flatten()
            n = np.where(spans.is_valid().to_numpy(zero_copy_only=False), n, 0)
            doc, start, end = _merged(np.repeat(np.arange(len(n)), n), *(flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "end")))
            lo, hi = np.searchsorted(doc, np.arange(len(n))), np.searchsorted(doc, np.arange(len(n)), side="right")
            whole = data.tobytes()
            cols = {"k": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i, k in enumerate(ids):
                text, kept, done = whole[offsets[i] : offsets[i + 1]], [], 0
                for j in range(lo[i], hi[i]):
                    kept.append(text[done : start[j]])
                    done = int(end[j])
                kept = b"".join([*kept, text[done:]])
                values = (k, len(text), len(text) - len(kept), int(hi[i] - lo[i]), hashlib.sha256(kept).hexdigest(), kept)
                for name, v in zip(cols, values, strict=True):
                    cols[name].append(v)
            if not clean:
                cols.pop("kept")
            yield pa.RecordBatch.from_pydict({"k": pa.array(cols.pop("k"), pa.int64()), **cols})

    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * clean
    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", kept: bool = False) -> DataFrame:
    """Columns (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): each text without the bytes that a LENGTH-byte string covers which also starts earlier.

    Earlier means a smaller key, or the same document and a smaller start; matches never cross documents and are judged on the input. A null text counts as empty;
    texts under LENGTH bytes lose nothing. Of equal texts only the one with the smallest key stays. Rows that repeat a key with its text count as one
    document and get the same result; a key with different texts is not defined. Keys are whole numbers (another type raises an error). Rows with a null
    key take no part: they lose nothing and remove nothing. An empty table gives no rows; other columns are ignored.
    """
    if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{key} must be a whole number, not {dict(docs.dtypes)[key]}")
    every = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    texts = every.where("k is not null")
    pieces = _pieces(texts, hot_anchors(texts))
    several = pieces.withColumn("n", F.count("g").over(Window.partitionBy("g", F.when(F.col("g").isNull(), F.col("doc")))))
    # a null group holds the spans that tasks have found themselves; they pass on with their documents
    several, _ = stored(several.where("n > 1 or g is null").drop("n"))
    asked = several.where("g is not null").groupBy(F.col("doc").alias("k")).agg(F.collect_list(F.struct("g", "start", "more", "lead")).alias("p"))
    own = lambda x: F.struct(x["g"].alias("g"), x["start"].alias("start"), x["more"].alias("more"), x["lead"].alias("lead"), F.substring("t", x["start"] + 1, x["more"] + LENGTH).alias("b"))
    bytes_ = texts.join(asked, "k").select(F.col("k").alias("doc"), F.explode(F.transform("p", own)).alias("x"))
    found = _match(bytes_.select("x.g", "doc", "x.start", "x.more", "x.lead", "x.b"))
    local = several.where("g is null").select("doc", "start", F.col("more").alias("end"))
    spans = found.unionAll(local).groupBy(F.col("doc").alias("k")).agg(F.collect_list(F.struct("start", "end")).alias("s"))
    out = _finish(texts.join(spans, "k", "left"), kept)
    zero = F.lit(0).cast("long")
    out = out.unionAll(every.where("k is null").select("k", F.length("t").cast("long"), zero, zero, F.sha2("t", 256), *[F.col("t")] * kept))
    return out.withColumnRenamed("k", key)


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
