"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Tokens that could be personal data (with a digit, an @, or very long) become nodes of a CRF:
neighbouring nodes share chain potentials; all repeats of one token in a document share a hub node by skip potentials, and the hubs of
similar tokens (equally long, two characters apart at most) are linked too: two by an edge, more by a hub of their group. What the repeats have in common (the token's shape) counts once,
at the hub; each repeat adds its own context. Loopy message passing then labels every node, so that what is plain in one place also
counts in the others. Unary, chain, skip and similarity weights are fitted together, by the pseudo-likelihood of distant labels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import query, table, text_chunks

KINDS = ["email", "ip", "card", "phone", "secret"]  #: in the order of ties; the last comes from the CRF alone
_O = len(KINDS)  # the label of all other tokens
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_CARD_SEPARATORS = re.compile(r"[\x20-]")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*|(?<!\S)[^\s0-9@]{24,}+(?!\S)")
_SHORTEST = 6  # shorter tokens are parts of numbers or plain numbers
_EDGE = "\"'`.,;:!?()[]{}<>#$%&*|=~"
_CUE = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|api|key|auth|bearer|credential)[\w-]{0,12}[\"']?\s{0,3}[=:]?\s{0,3}[\"'#$%&*]{0,6}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the pattern matches, leftmost and non-overlapping per kind, by start and then kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def nodes(text: str) -> list[tuple[int, int]]:
    """Cores (without surrounding punctuation) of the tokens that could be personal data."""
    out = []
    for m in _TOKEN.finditer(text):
        core = m.group().strip(_EDGE)
        if len(core) >= _SHORTEST:
            start = m.start() + m.group().index(core)
            out.append((start, start + len(core)))
    return out


_FEATURES = 20
_ASSIGNED = re.compile(r"[=:]\s{0,3}[\"'#$%&*]{0,6}$")


def features(text: str, start: int, end: int) -> np.ndarray:
    """The shape of a token and what stands just before it; patterns' results are no features."""
    core = text[start:end]
    digits = sum(c in "0123456789" for c in core)
    letters = sum(c.isalpha() for c in core)
    n = len(core)
    cue = _CUE.search(text, max(0, start - 48), start) is not None
    hexlike = n >= 16 and digits > 0 and letters > 0 and re.fullmatch(r"[0-9A-Fa-f]+", core) is not None
    mixed = n >= 8 and digits > 0 and letters > 0 and "@" not in core
    parts = core.split(".")
    f = np.zeros(_FEATURES, np.float32)
    f[0] = 1
    f[1] = "@" in core
    f[2] = "@" in core and "." in core[core.find("@") :]
    f[3] = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    f[4] = f[3] and all(len(p) < 4 and int(p) < 256 for p in parts)
    f[5] = digits == n and 12 <= n <= 19
    f[6] = f[5] and luhn("".join(c if c in "0123456789" else "0" for c in core))
    f[7] = digits == n and n < 9
    f[8] = digits == n and 9 <= n < 12
    f[9] = text[start - 1 : start] == "+" or core[0] == "+"
    f[10] = hexlike
    f[11] = hexlike and cue
    f[12] = cue
    f[13] = start > 0 and text[start - 1] in "\"'"
    f[14] = n >= 24 and digits > 0 and letters > 0
    f[15] = digits == 0
    f[16] = digits == n and n > 19
    f[17] = re.fullmatch(r"[0-9]+(?:-[0-9]+)+", core) is not None
    f[18] = mixed
    f[19] = mixed and cue and _ASSIGNED.search(text, max(0, start - 12), start) is not None
    return f


#: Prior unary weights (feature, label, weight) that training starts from and is drawn to, so that labels rare in the sample keep their shape.
#: A string without a cue stays unlabelled by itself: its repeats and likenesses decide.
_PRIOR = [(0, _O, 2.0), (2, 0, 6.0), (4, 1, 6.0), (6, 2, 5.0), (9, 3, 3.0), (17, 3, 1.0), (10, 4, 0.5), (11, 4, 3.0), (12, 4, 0.5), (13, 4, 0.3), (14, 4, 0.2), (19, 4, 4.0)]
_AGREE, _LIKE = 2.5, 1.5  # prior weights of equal labels on skip and similarity edges


def _prior() -> np.ndarray:
    w = np.zeros((_FEATURES, len(KINDS) + 1))
    for f, label, x in _PRIOR:
        w[f, label] = x
    return w


def _unary(model_w: np.ndarray, feats: np.ndarray, shape: np.ndarray | None = None) -> np.ndarray:
    """Label scores; labels whose shape a token can't have (an email without @, a card number without its digits) are ruled out, by the features `shape` if given."""
    z = feats @ model_w
    f = (feats if shape is None else shape) > 0
    digits = f[:, 5] | f[:, 7] | f[:, 8] | f[:, 16] | f[:, 17]
    secret = f[:, 10] | f[:, 14] | f[:, 12] | f[:, 18]
    possible = np.stack([f[:, 1], f[:, 3], f[:, 5] | f[:, 17], digits | f[:, 9], secret, np.ones(len(f), bool)], axis=1)
    return np.where(possible, z, -20.0)


@dataclass
class Crf:
    unary: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels, of neighbouring nodes
    skip: np.ndarray  # labels by labels, of a repeat and its hub
    similar: np.ndarray  # labels by labels, of two similar tokens


@dataclass
class Graph:
    """Nodes of all texts with their documents and features, chain edges, repeats (each with the one before), and groups of similar tokens: (first place, group)."""

    spans: list
    docs: list
    feats: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    similar: np.ndarray


def _agreeing(letters: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of the given rows (equally long words as code points) that agree in all places but two at most; any two rows at most two apart share a group.

    Of three parts of the places that vary, two such rows agree in one: rows are parted by each of them in turn, until two places are left.
    """
    vary = np.flatnonzero((letters[rows] != letters[rows[0]]).any(0))
    if len(vary) <= 2:
        yield rows
        return
    for part in np.array_split(vary, 3):
        cells = np.ascontiguousarray(letters[np.ix_(rows, part)])
        _, which, size = np.unique(cells.view(np.dtype((np.void, cells.itemsize * len(part)))).ravel(), return_inverse=True, return_counts=True)
        order = np.argsort(which, kind="stable")
        for group in np.split(order, np.cumsum(size)[:-1]):
            if len(group) > 1:
                yield from _agreeing(letters, rows[group])


def _alike(first: dict[str, int]) -> list[list[int]]:
    """Groups of a document's similar tokens, by their first places: equally long and of one kind, and any two of a group two characters apart at most.

    All such pairs share a group; a group inside another one is left out.
    """
    buckets: dict[tuple, list[str]] = {}
    for name in first:
        if len(name) >= 8 and any(c.isdigit() for c in name):
            buckets.setdefault((len(name), any(c.isalpha() for c in name), "@" in name), []).append(name)
    out = []
    for names in buckets.values():
        if len(names) > 1:
            letters = np.array(names).view(np.uint32).reshape(len(names), -1)
            at: list[set[int]] = [set() for _ in names]
            found = sorted({tuple(g.tolist()) for g in _agreeing(letters, np.arange(len(names)))}, key=lambda g: (-len(g), g))
            for k, group in enumerate(found):
                if not set.intersection(*(at[r] for r in group)):
                    out.append(sorted(first[names[r]] for r in group))
                    for r in group:
                        at[r].add(k)
    return sorted(out)


def graph(texts: list[str], near: int = 24) -> Graph:
    spans, docs, feats, chain, skip, similar, groups = [], [], [], [], [], [], 0
    for d, text in enumerate(texts):
        last, seen, first = None, {}, {}
        for start, end in nodes(text):
            i = len(spans)
            spans.append((start, end))
            docs.append(d)
            feats.append(features(text, start, end))
            if last is not None and start - spans[last][1] <= near:
                chain.append((last, i))
            name = text[start:end].lower()
            if name in seen:
                # repeats are linked one after the other, so edges grow with the tokens, not with their pairs
                skip.append((seen[name], i))
            first.setdefault(name, i)
            seen[name] = last = i
        for group in _alike(first):
            similar += [(i, groups) for i in group]
            groups += 1
    edge = lambda e: np.array(e, np.int64).reshape(-1, 2)
    return Graph(spans, docs, np.array(feats, np.float32).reshape(-1, _FEATURES), edge(chain), edge(skip), edge(similar))


def _hubs(skip: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The repeated nodes and the number of each one's hub, from edges that chain the repeats of a token in ascending order."""
    first = np.arange(n)
    for a, b in skip:
        first[b] = first[a]
    copies = np.unique(skip)
    _, hub = np.unique(first[copies], return_inverse=True)
    return copies, hub


def _neutral(weights: np.ndarray) -> np.ndarray:
    """exp(weights) with rows and columns scaled to 1: a node that knows nothing then tells its neighbour nothing."""
    p = np.exp((weights + weights.T) / 2)
    for _ in range(200):
        p /= np.sqrt(p.sum(0, keepdims=True) * p.sum(1, keepdims=True))
    return p


def _likenesses(var: np.ndarray, similar: np.ndarray, n: int) -> np.ndarray:
    """Edges of groups of similar tokens: two share an edge, the members of a larger group one each with the group's hub, which is numbered from n on."""
    group = similar[:, 1]
    two = np.bincount(group)[group] == 2 if len(group) else np.zeros(0, bool)
    pairs = var[similar[two, 0]].reshape(-1, 2)
    _, hub = np.unique(group[~two], return_inverse=True)
    return np.concatenate([pairs, np.stack([var[similar[~two, 0]], hub + n], axis=1)])


def factors(model: Crf, g: Graph):
    """Scores of all variables (the nodes, then one hub per repeated token, then one per group of three or more similar tokens), edges between them with their potentials, and the nodes' ruled out labels."""
    feats, n = g.feats, len(g.feats)
    copies, hub = _hubs(g.skip, n)
    own, shape = feats.copy(), feats.copy()
    var = np.arange(n)  # the variable that stands for a token: its hub, if it has one
    if len(copies):
        common = np.full((hub.max() + 1, feats.shape[1]), np.inf, np.float32)
        np.minimum.at(common, hub, feats[copies])
        every = np.zeros_like(common)
        np.maximum.at(every, hub, feats[copies])
        own[copies] -= common[hub]
        shape[copies] = every[hub]
        own, shape = np.concatenate([own, common]), np.concatenate([shape, every])
        var[copies] = hub + n
    unary = _unary(model.unary, own, shape).astype(np.float64)
    ruled_out = np.zeros((n, unary.shape[1]))
    if len(copies):
        # a repeat without evidence has to send its hub a flat message, or many would outvote one cue: labels are ruled out at the hub and at the end
        ruled_out[copies] = np.where(unary[hub + n] == -20.0, -20.0, 0.0)
        unary[copies] = own[copies] @ model.unary
    # the neighbours of m repeats count as a share each: the same plain line m times is no more evidence than once
    m = np.ones(n)
    m[copies] = np.bincount(hub)[hub] if len(copies) else 1
    share = np.maximum(m[g.chain[:, 0]], m[g.chain[:, 1]])[:, None, None]
    star = np.stack([copies, hub + n], axis=1).astype(np.int64)
    like = _likenesses(var, g.similar, len(unary))
    unary = np.concatenate([unary, np.zeros((max(0, int(like.max(initial=-1)) + 1 - len(unary)), unary.shape[1]))])
    edges = np.concatenate([g.chain, star, like])
    pots = [np.exp(model.chain[None] / share), np.repeat(_neutral(model.skip)[None], len(star), 0), np.repeat(_neutral(model.similar)[None], len(like), 0)]
    return unary, edges, np.concatenate(pots), ruled_out


def sum_product(unary: np.ndarray, edges: np.ndarray, pots: np.ndarray, damping: float = 0.3, settled: float = 1e-4) -> np.ndarray:
    """Log beliefs (up to a constant per variable) by damped loopy message passing until the messages settle; exact where the graph has no cycle.

    Messages round a cycle need not settle by themselves: the damping grows slowly, so that the rounds end.
    """
    belief = unary.astype(np.float64)
    pot = np.concatenate([pots, pots.transpose(0, 2, 1)])
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(src), unary.shape[1]))
    stale = np.arange(len(src))  # messages whose input has changed
    while len(stale):
        out = belief[src[stale]] - message[back[stale]]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ea,eab->eb", out, pot[stale]) + 1e-300)
        new -= new.max(1, keepdims=True)
        step = (1 - damping) * (new - message[stale])
        message[stale] += step
        np.add.at(belief, dst[stale], step)
        moved = np.abs(step).max(1) > settled
        touched = np.zeros(len(belief), bool)
        touched[dst[stale[moved]]] = True
        again = touched[src]
        again[stale[moved]] = True
        stale = np.flatnonzero(again)
        damping += (1 - damping) * 0.01
    return belief


def marginals(model: Crf, g: Graph) -> np.ndarray:
    """Label probabilities of all nodes of all documents at once. Any two repeats of a token are two edges apart, by their hub."""
    unary, edges, pots, ruled_out = factors(model, g)
    belief = sum_product(unary, edges, pots)[: len(g.feats)] + ruled_out
    e = np.exp(belief - belief.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _labels_by_rule(texts: list[str], g: Graph) -> np.ndarray:
    """Distant labels: a node's base kind where a base span covers it, `secret` for strings after a cue, and for all repeats of such a string."""
    y = np.full(len(g.spans), _O)
    secret = KINDS.index("secret")
    bases = [base_spans(t) for t in texts]
    for i, (start, end) in enumerate(g.spans):
        for a, b, kind in bases[g.docs[i]]:
            if a < end and start < b:
                y[i] = kind
                break
        else:
            f = g.feats[i]
            if (f[12] and (f[10] or f[14])) or f[19]:
                y[i] = secret
    copies, hub = _hubs(g.skip, len(y))
    if len(copies):
        said = np.zeros(hub.max() + 1, bool)
        np.logical_or.at(said, hub, y[copies] == secret)
        y[copies[said[hub] & (y[copies] == _O)]] = secret
    return y


def fit_texts(texts: list[str], rounds: int = 300) -> Crf:
    """All weights together, by gradient descent on the pseudo-likelihood: each node's label given its features and the labels of its neighbours on
    the chain, of its token's other repeats and of similar tokens; drawn to the prior weights."""
    g = graph(texts)
    k = len(KINDS) + 1
    prior = [_prior(), np.zeros((k, k)), _AGREE * np.eye(k), _LIKE * np.eye(k)]
    w, chain, skip, similar = (p.copy() for p in prior)
    n = len(g.spans)
    if not n:
        return Crf(w, chain, skip, similar)
    y = _labels_by_rule(texts, g)
    onehot = np.eye(k)[y]
    left, right, others, like = (np.zeros((n, k)) for _ in range(4))
    right[g.chain[:, 0]] = onehot[g.chain[:, 1]]
    left[g.chain[:, 1]] = onehot[g.chain[:, 0]]
    copies, hub = _hubs(g.skip, n)
    if len(copies):
        total = np.zeros((hub.max() + 1, k))
        np.add.at(total, hub, onehot[copies])
        rest = total[hub] - onehot[copies]
        others[copies] = rest / rest.sum(1, keepdims=True)
    if len(g.similar):
        place, group = g.similar.T
        total = np.zeros((group.max() + 1, k))
        np.add.at(total, group, onehot[place])
        np.add.at(like, place, total[group] - onehot[place])
        like /= np.maximum(like.sum(1, keepdims=True), 1)
    for step in range(rounds):
        z = _unary(w, g.feats) + left @ chain + right @ chain.T + others @ skip + like @ similar
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - onehot) / n
        rate = 4.0 / (1 + step / 150)
        grads = [g.feats.T @ d, left.T @ d + (right.T @ d).T, others.T @ d, like.T @ d]
        for x, gr, x0 in zip((w, chain, skip, similar), grads, prior, strict=True):
            x -= rate * (gr + 1e-3 * (x - x0))
    bounded = lambda x: np.clip(x, -3, 3)  # noqa: E731  no edge outweighs a plain token
    return Crf(w, bounded(chain), bounded((skip + skip.T) / 2), bounded((similar + similar.T) / 2))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1500, longest: int = 200_000) -> Crf:
    """A CRF from at most `most` texts of at most `longest` characters that hold a digit or an @ (the documented bounds; rows by hash order of the key, then text)."""
    order = F.xxhash64(F.col(key), F.col(text))
    rows = docs.where((F.length(text) <= longest) & F.col(text).rlike("[@+]|[0-9]{4}|[0-9]\\.[0-9]")).select(F.col(text).alias("t"), order.alias("o"))
    n = rows.count()
    thin = rows.where(F.pmod(F.col("o"), F.lit(1_000_000)) < int(min(1.0, 2.0 * most / max(n, 1)) * 1_000_000) + 1)
    return fit_texts([r["t"] for r in thin.orderBy("o").limit(most).collect()])


def annotate(texts: list[str], model: Crf, sure: float = 0.5) -> list[tuple[list, list]]:
    """Of each text, its base spans and all spans: the base ones and the CRF's tokens that touch none of them."""
    bases = [base_spans(t) for t in texts]
    g = graph(texts)
    spans, docs = g.spans, g.docs
    extra = [[] for _ in texts]
    if spans:
        p = marginals(model, g)
        best = p.argmax(1)
        for i in np.flatnonzero((best != _O) & (p.max(1) >= sure)):
            start, end = spans[i]
            if not any(a < end and start < b for a, b, _ in bases[docs[i]]):
                extra[docs[i]].append((start, end, int(best[i])))
    return [(b, sorted(b + x, key=lambda s: (s[0], s[2]))) for b, x in zip(bases, extra, strict=True)]


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Crf, key: str = "doc_id", text: str = "text", redacted: bool = False) -> DataFrame:
    """Columns (key, n_email, n_ip, n_card, n_phone, base_sha256, spans[, redacted]) of every row, over whole texts.

    Null and empty texts have no spans (sha256 of nothing, empty `spans`). Positions count code points, ends are exclusive. Rows that repeat a key, and those
    with a null one, are each a document of their own. Very long texts are read whole, alone in their batch. An empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for batch in text_chunks(batches, "t", 1 << 20):
            texts = batch.column("t").to_pylist()
            rows = annotate(texts, model)
            cols = {"k": batch.column("k")}
            for i in range(4):
                cols[f"n_{KINDS[i]}"] = pa.array([sum(s[2] == i for s in b) for b, _ in rows], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in rows], pa.string())
            cols["spans"] = pa.array([_written(s) for _, s in rows], pa.string())
            if redacted:
                cols["redacted"] = pa.array([redact(t, s) for t, (_, s) in zip(texts, rows, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = f"k {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redacted
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def redacted(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """The same rows and columns with every span in `text` replaced by its kind in brackets; null texts stay null."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for part in text_chunks(iter([batch]), text, 1 << 20):
                texts = part.column(at).to_pylist()
                marked = annotate([t or "" for t in texts], model)
                new = pa.array([None if t is None else redact(t, s) for t, (_, s) in zip(texts, marked, strict=True)], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)


@query("op1_pii_crf")
def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
