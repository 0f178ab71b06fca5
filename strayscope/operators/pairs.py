"""Exact all-pairs vector scans without cross joins.

Every nearest-neighbour style operator (min L2, max cosine, k nearest,
k nearest per class, soft-max statistics) is a *mergeable* reduction over the
pairs (query, reference).  ``pair_scan`` evaluates such a reduction with numpy
block products inside Spark tasks and never materialises pair rows:

* **broadcast path** - the reference side is counted first; when
  ``rows * dim * 8`` is under ``broadcast_bytes`` it is shipped once as a
  broadcast variable and the queries are streamed through ``mapInPandas``
  (no shuffle of the query side at all);
* **shared path** - nearest neighbours among more references read them from the shared
  folder, a block of at most ``SHARED_BLOCK_BYTES`` at a time: neither side is sent anywhere,
  and a task bounds later blocks by the nearest found in earlier ones;
* **block path** - for the other reductions the reference rows are hashed into blocks
  of at most ``block_bytes`` and the queries too.  Small blocks are dealt into
  ``B`` and ``Q`` bunches (``bunches``: of at most ``DEFAULT_BLOCK_BYTES``), so that rows aren't
  sent once for each tiny block; every (query bunch, reference bunch) cell is one
  ``cogroup`` group, so no task ever holds more than one bunch of each side.  Each cell
  emits per-query partial results which a ``groupBy`` merges.  Shuffle volume is
  ``n_query * B + n_ref * Q`` rows, independent of any key skew because
  blocks are assigned by hashing unique ids.

Inside a task the work is chunked again (``QUERY_CHUNK`` x ``REF_CHUNK``) so
memory per task stays flat whatever the block sizes are.  The nearest references found in
earlier chunks bound the later ones: only pairs that can still be among them leave the product.
Many references are dealt into ``Leaves`` of near ones; leaves whose ball lies farther than
the k nearest found so far are left out, unless that saves too little (``TREE_PAYS``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import located, written

DEFAULT_BROADCAST_BYTES = 16 << 20  # it passes through the driver, and each Python worker holds one copy
DEFAULT_BLOCK_BYTES = 32 << 20
FEWEST_BUNCHES = 8  # smaller blocks stay apart while they are no more than these
QUERY_CHUNK = 1024
REF_CHUNK = 4096
SHARED_BLOCK_BYTES = 64 << 20
SHARED_QUERIES = 1 << 16  # of a task at a time
LEAF, TREE_LEAST = 128, 8192  # references of a leaf, and that are dealt into leaves
TREE_QUERIES = 128  # near ones, which meet the same leaves
TREE_TRIED, TREE_PAYS = 8, 0.5  # after so many products the leaves go if they left out less than this share


TIED_PAIRS = 1 << 15


@dataclass
class RefBlock:
    ids: np.ndarray          # int64 [m]
    mat: np.ndarray          # float64 [m, d]
    labels: np.ndarray | None  # object [m] or None
    trees: dict = field(default_factory=dict)  # of sets of rows, by class
    right: np.ndarray | None = None  # of the products

    @staticmethod
    def from_pandas(pdf: pd.DataFrame, label_col: str | None, op: "PairOp | None" = None) -> "RefBlock":
        pdf = pdf[pdf["v"].notna()]
        ids = pdf["id"].to_numpy(dtype=np.int64)
        mat = _stack(pdf["v"])
        if op is not None:
            mat = op.prep(mat)
        labels = pdf[label_col].to_numpy(dtype=object) if label_col else None
        return RefBlock(ids, mat, labels)

    def chunks(self, size: int = REF_CHUNK):
        for s in range(0, len(self.ids), size):
            e = s + size
            yield RefBlock(self.ids[s:e], self.mat[s:e],
                           None if self.labels is None else self.labels[s:e])


_DTYPES = {"long": "int64", "int": "int32", "double": "float64", "string": "object", "boolean": "bool"}


def empty_frame(schema: str) -> pd.DataFrame:
    """A zero-row pandas frame whose dtypes match a DDL schema string."""
    cols = [c.strip().split(" ", 1) for c in schema.split(",")]
    return pd.DataFrame({n: pd.Series([], dtype=_DTYPES.get(t.strip(), "object")) for n, t in cols})


def _stack(series: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim or 0), dtype=np.float64)
    return np.vstack([np.asarray(x, dtype=np.float64) for x in series.values])


class PairOp:
    """A mergeable reduction over (query, reference) pairs.

    ``transform`` = (mean, basis) optionally maps every vector of both sides
    to ``(x - mean) @ basis`` before the reduction (PCA / centring)."""

    schema: str = ""
    query_extra: tuple[str, ...] = ()
    transform: tuple[np.ndarray, np.ndarray | None] | None = None

    def prep(self, mat: np.ndarray) -> np.ndarray:
        if self.transform is None or mat.shape[0] == 0:
            return mat
        mean, basis = self.transform
        out = mat - mean[None, :]
        return out if basis is None else out @ basis

    def run(self, q: pd.DataFrame, refs: RefBlock) -> pd.DataFrame:
        q = q[q["v"].notna()]
        if len(q) == 0 or len(refs.ids) == 0:
            return self.empty()
        parts = []
        for s in range(0, len(q), QUERY_CHUNK):
            qc = q.iloc[s:s + QUERY_CHUNK]
            qids = qc["id"].to_numpy(dtype=np.int64)
            qmat = self.prep(_stack(qc["v"]))
            extra = {c: qc[c].to_numpy() for c in self.query_extra}
            chunk_parts = [self.partial(qids, qmat, extra, rc) for rc in refs.chunks()]
            parts.append(self.combine(pd.concat(chunk_parts, ignore_index=True)))
        return pd.concat(parts, ignore_index=True)

    def empty(self) -> pd.DataFrame:
        return empty_frame(self.schema)

    # to be provided by subclasses
    def partial(self, qids, qmat, extra, refs: RefBlock) -> pd.DataFrame:
        raise NotImplementedError

    def combine(self, pdf: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def merge(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


def _sq_dists(qmat: np.ndarray, rmat: np.ndarray) -> np.ndarray:
    qn = np.einsum("ij,ij->i", qmat, qmat)
    rn = np.einsum("ij,ij->i", rmat, rmat)
    d2 = qn[:, None] + rn[None, :] - 2.0 * (qmat @ rmat.T)
    np.maximum(d2, 0.0, out=d2)
    return d2


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", mat, mat))
    out = np.zeros_like(mat)
    nz = n > 0
    out[nz] = mat[nz] / n[nz, None]
    return out


class Leaves:
    """Points in small sets of near ones, each in a ball.  A set is halved at the median
    along its longest direction, so neighbours in the order are mostly near, too."""

    def __init__(self, points: np.ndarray):
        order = np.flatnonzero(np.isfinite(np.einsum("ij,ij->i", points, points)))  # others are near to none
        stack, starts = [(0, len(order))] if len(order) else [], []
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAF:
                starts.append(lo)
                continue
            mine, mid = order[lo:hi], (hi - lo) // 2
            x = points[mine]
            some = x[::max(1, (hi - lo) // 512)]
            some = some - some.mean(axis=0)
            along = some[np.argmax(np.einsum("ij,ij->i", some, some))]
            for _ in range(3):
                along = some.T @ (some @ along)
                size = np.sqrt(along @ along)
                along = along / size if 0 < size < np.inf else np.zeros(points.shape[1])
            order[lo:hi] = mine[np.argpartition(x @ along, mid)]
            stack += [(lo + mid, hi), (lo, lo + mid)]
        self.order, self.starts = order, np.array(starts, np.int64)
        self.sizes = np.diff(np.append(self.starts, len(order)))
        x = points[order]
        self.centres = np.add.reduceat(x, self.starts, axis=0) / self.sizes[:, None] if starts else np.zeros((0, points.shape[1]))
        away = x - np.repeat(self.centres, self.sizes, axis=0)
        radii = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), self.starts)) if starts else np.zeros(0)
        self.radii = np.where(np.isfinite(radii), radii, np.inf)
        self.margin = 1e-7 * (1.0 + float(np.sqrt(np.einsum("ij,ij->i", x, x)).max(initial=0.0)))  # for rounding
        self.tried = self.visited = 0

    def pays(self) -> bool:
        return self.tried < TREE_TRIED or self.visited <= (1 - TREE_PAYS) * self.tried

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To the centres; 0 where it isn't a number, so that nothing is left out."""
        away = np.sqrt(_sq_dists(points, self.centres))
        return np.where(np.isfinite(away), away, 0.0)

    def rows(self, leaves: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.sizes[leaves])
        return self.order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[leaves] - (ends - self.sizes[leaves]), self.sizes[leaves])]


class NearestOp(PairOp):
    """k nearest references per query (optionally per reference class).

    ``metric``: ``l2`` (distance), ``cosine_sim`` (largest similarity first,
    zero vectors have similarity 0) or ``cosine_dist`` (1 - cos, clipped to
    [0, 2]).  Ties are broken by reference id.  ``exclude_self`` drops the
    pair whose ids are equal (training-set self joins).  Output: one row per
    (query, [class], rank) with ``rank`` 1..k.
    """

    def __init__(self, k: int = 1, metric: str = "l2", by_class: bool = False,
                 exclude_self: bool = False, same_label: bool = False):
        self.k, self.metric, self.by_class, self.exclude_self = k, metric, by_class, exclude_self
        self.same_label = same_label
        if same_label:
            self.query_extra = ("qlabel",)
        cls = "cls string, " if by_class else ""
        self.schema = f"qid long, {cls}rank int, ref_id long, ref_label string, value double"

    def _left(self, qmat):
        """Query side of the product whose entries are the ordering keys (smaller is better)."""
        if self.metric != "l2":
            return -_unit(qmat), np.zeros(len(qmat))
        qn = np.einsum("ij,ij->i", qmat, qmat)
        left = np.concatenate([-2.0 * qmat, np.ones((len(qmat), 1))], axis=1)
        left[~np.isfinite(qn)] = np.nan  # such a row is near to none
        return left, qn

    def _right(self, refs):
        """Reference side, made once for a block."""
        if refs.right is None:
            if self.metric != "l2":
                refs.right = _unit(refs.mat)
            else:
                rn = np.einsum("ij,ij->i", refs.mat, refs.mat)
                refs.right = np.concatenate([refs.mat, rn[:, None]], axis=1)
                refs.right[~np.isfinite(rn)] = np.nan
        return refs.right

    def _slack(self, right, qn):
        """Tolerance of the keys."""
        if self.metric != "l2":
            return 1e-12
        return 1e-9 * (1.0 + sum(float(np.max(n, initial=0.0, where=np.isfinite(n))) for n in (qn, right[:, -1])))

    def _key_of(self, value, qn):
        """Ordering key of an exact value."""
        if self.metric == "l2":
            return value * value - qn
        return -value if self.metric == "cosine_sim" else value - 1.0

    def _exact(self, qmat, rmat, qi, ri):
        if self.metric == "l2":
            diff = qmat[qi] - rmat[ri]
            return np.sqrt(np.einsum("ij,ij->i", diff, diff))
        a, b = qmat[qi], rmat[ri]
        na = np.sqrt(np.einsum("ij,ij->i", a, a))
        nb = np.sqrt(np.einsum("ij,ij->i", b, b))
        dot = np.einsum("ij,ij->i", a, b)
        den = na * nb
        cos = np.divide(dot, den, out=np.zeros_like(dot), where=den > 0)
        if self.metric == "cosine_sim":
            return cos
        return np.clip(1.0 - cos, 0.0, 2.0)

    def farthest(self):
        """A value that no reference's is behind."""
        return {"l2": np.inf, "cosine_sim": -1.1, "cosine_dist": 2.1}[self.metric]

    def _kth(self, key):
        """Each row's k-th smallest key (the largest number if it has fewer)."""
        if key.shape[1] < self.k:
            return np.full(len(key), np.finfo(np.float64).max)
        kth = np.fmin.reduce(key, axis=1) if self.k == 1 else np.partition(key, self.k - 1, axis=1)[:, self.k - 1]
        return np.where(np.isfinite(kth), kth, np.finfo(np.float64).max)

    def _settled(self, qmat, rmat, qi, ri, ids, kept):
        """The k first of each query's candidates by (exact value, reference id), with those
        ``kept`` before.  Candidates (many, if many references tie) are compared a bounded
        number at a time."""
        for s in range(0, len(qi), TIED_PAIRS):
            q, r = qi[s:s + TIED_PAIRS], ri[s:s + TIED_PAIRS]
            q, r, val = (np.concatenate([a, b]) for a, b in zip(kept, (q, r, self._exact(qmat, rmat, q, r))))
            order = np.lexsort((ids[r], -val if self.metric == "cosine_sim" else val, q))
            q, r, val = q[order], r[order], val[order]
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            kept = [a[place < self.k] for a in (q, r, val)]
        return kept

    def _space(self, mat):
        """Points whose Euclidean distances the keys follow."""
        return mat if self.metric == "l2" else _unit(mat)

    def _tree(self, refs, cls, among):
        if len(among) < TREE_LEAST:
            return None
        if cls not in refs.trees:
            refs.trees[cls] = Leaves(self._space(refs.mat[among]))
        return refs.trees[cls] if refs.trees[cls].pays() and len(refs.trees[cls].starts) else None

    def _key_bound(self, away, qmat, qn):
        """Least ordering key of references at a distance of ``away`` or more."""
        return away * away - qn[:, None] if self.metric == "l2" else (away * away - 2.0) / 2

    def _rounds(self, tree, qmat, qn, among, bound):
        """The references ``among`` that can be near enough, a chunk at a time, nearest leaves first.
        ``bound``, the largest key still of use, falls meanwhile."""
        if tree is None:
            yield from (among[s:s + REF_CHUNK] for s in range(0, len(among), REF_CHUNK))
            return
        away = tree.distances(self._space(qmat))
        floor = self._key_bound(np.maximum(away - tree.radii[None, :] - tree.margin, 0.0), qmat, qn)
        tree.tried += 1
        near = np.argsort(away.min(axis=0), kind="stable")
        step = np.searchsorted(np.cumsum(tree.sizes[near]), REF_CHUNK // 4) + 1
        chosen, left = near[:step], None
        while len(chosen):
            tree.visited += tree.sizes[chosen].sum() / len(tree.order)
            yield among[tree.rows(chosen)]
            if left is None:
                left = near[step:]
            left = left[(floor[:, left] <= bound[0][:, None]).any(axis=0)]
            step = np.searchsorted(np.cumsum(tree.sizes[left]), REF_CHUNK) + 1
            chosen, left = left[:step], left[step:]

    def _nearest(self, qids, qmat, refs, among, tree=None, known=None):
        """(query, reference, exact value) of the k nearest of the references ``among``.  A
        pair leaves its chunk's product only if its key is within the tolerance of the query's
        k-th best so far (``known``: of other references); those that do are settled when there are several for each place."""
        left, qn = self._left(qmat)
        bound, slack = np.full(len(qids), np.finfo(np.float64).max), 0.0
        if known is not None:
            bound = np.minimum(bound, self._key_of(known, qn))
        if tree is not None:
            slack = self._slack(self._right(refs)[among] if self.metric == "l2" else None, qn)
        use = [bound + slack]
        kept, waiting, n = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)], [], 0

        def settle():
            kept_now = self._settled(qmat, refs.mat, *(np.concatenate(x) for x in zip(*waiting)), refs.ids, kept)
            counts = np.bincount(kept_now[0], minlength=len(qids))
            full = counts >= self.k
            worst = kept_now[2][(np.cumsum(counts) - 1)[full]]
            bound[full] = np.minimum(bound[full], self._key_of(worst, qn[full]))
            return kept_now

        for at in self._rounds(tree, qmat, qn, among, use):
            right = self._right(refs)[at]
            slack = max(slack, self._slack(right, qn))
            key = left @ right.T
            if self.exclude_self:
                key[qids[:, None] == refs.ids[at][None, :]] = np.nan
            if not waiting and not len(kept[0]):
                bound = np.minimum(bound, self._kth(key))
            qi, cj = np.nonzero(key <= (bound + slack)[:, None])
            waiting.append((qi, at[cj]))
            n += len(qi)
            if n >= (4 * self.k * len(qids) if tree is not None else max(TIED_PAIRS, 4 * self.k * len(qids))):
                kept, waiting, n = settle(), [], 0
            use[0] = bound + slack
        return settle() if waiting else kept

    def run(self, q, refs, known=None):
        """``known``: the k-th best values of other references, by query id."""
        q = q[q["v"].notna()]
        if len(q) == 0 or len(refs.ids) == 0:
            return self.empty()
        mat = self.prep(_stack(q["v"]))
        order, size = np.arange(len(q)), QUERY_CHUNK
        tree = self._tree(refs, None, np.arange(len(refs.ids)))
        if tree is not None:
            near = [np.argmin(tree.distances(np.nan_to_num(self._space(mat[s:s + QUERY_CHUNK]))), axis=1) for s in range(0, len(q), QUERY_CHUNK)]
            order, size = np.argsort(np.concatenate(near), kind="stable"), TREE_QUERIES
        qids, extra = q["id"].to_numpy(dtype=np.int64), {c: q[c].to_numpy() for c in self.query_extra}
        parts = []
        s = 0
        while s < len(q):
            at = order[s:s + (size if tree is None or tree.pays() else QUERY_CHUNK)]
            s += len(at)
            parts.append(self.partial(qids[at], mat[at], {c: x[at] for c, x in extra.items()}, refs, None if known is None else known[at]))
        found = pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True)
        return self.combine(found) if len(found) else self.empty()

    def partial(self, qids, qmat, extra, refs, known=None):
        labels = refs.labels if refs.labels is not None else np.full(len(refs.ids), None, dtype=object)
        every, own = np.arange(len(refs.ids)), np.arange(len(qids))
        sets = [(None, own, every)]  # class, its queries, its references
        if self.by_class or self.same_label:
            asked = extra["qlabel"].astype(object) if self.same_label else labels[:0]
            codes, names = pd.factorize(np.concatenate([labels, asked]))
            mine, theirs = codes[:len(labels)], codes[len(labels):]
            found = np.unique(mine)
            sets = [(None if c < 0 else names[c], np.flatnonzero(theirs == c) if self.same_label else own, np.flatnonzero(mine == c)) for c in found]
        frames = []
        for cls, rows, among in sets:
            if not len(rows):
                continue
            key = ("class", cls) if self.by_class or self.same_label else None
            qi, ri, val = self._nearest(qids[rows], qmat[rows], refs, among, self._tree(refs, key, among), known)
            fr = pd.DataFrame({"qid": qids[rows[qi]], "ref_id": refs.ids[ri], "ref_label": labels[ri], "value": val})
            if self.by_class:
                fr.insert(1, "cls", cls)
            frames.append(fr)
        return pd.concat(frames, ignore_index=True) if frames else self.empty()

    def combine(self, pdf):
        group = ["qid", "cls"] if self.by_class else ["qid"]
        asc = self.metric != "cosine_sim"
        pdf = pdf.sort_values(group + ["value", "ref_id"],
                              ascending=[True] * len(group) + [asc, True], kind="mergesort")
        pdf = pdf.groupby(group, sort=False).head(self.k).copy()
        pdf["rank"] = pdf.groupby(group, sort=False).cumcount().astype("int32") + 1
        cols = ["qid"] + (["cls"] if self.by_class else []) + ["rank", "ref_id", "ref_label", "value"]
        return pdf[cols]

    def merge(self, df):
        group = ["qid", "cls"] if self.by_class else ["qid"]
        order = F.col("value").asc() if self.metric != "cosine_sim" else F.col("value").desc()
        w = Window.partitionBy(*group).orderBy(order, F.col("ref_id").asc())
        return (df.drop("rank").withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= self.k)
                .select("qid", *(["cls"] if self.by_class else []), "rank", "ref_id", "ref_label", "value"))


class SoftmaxStatsOp(PairOp):
    """Pass 1 of the adjusted-softmax entropy: per query the largest cosine
    (first reference id on ties), and the sum of exp(cos) over all references."""

    schema = "qid long, top_sim double, top_id long, sum_exp double, n long"

    def partial(self, qids, qmat, extra, refs):
        sims = _unit(qmat) @ _unit(refs.mat).T
        best = np.argmax(sims, axis=1)  # first max = smallest position
        top = sims[np.arange(len(qids)), best]
        # exact first-id tie-break inside the chunk
        ties = sims >= top[:, None]
        ids_masked = np.where(ties, refs.ids[None, :], np.iinfo(np.int64).max)
        top_id = ids_masked.min(axis=1)
        return pd.DataFrame({"qid": qids, "top_sim": top, "top_id": top_id,
                             "sum_exp": np.exp(sims).sum(axis=1), "n": np.full(len(qids), sims.shape[1])})

    def combine(self, pdf):
        pdf = pdf.sort_values(["qid", "top_sim", "top_id"], ascending=[True, False, True], kind="mergesort")
        agg = pdf.groupby("qid", sort=False).agg(top_sim=("top_sim", "first"), top_id=("top_id", "first"),
                                                 sum_exp=("sum_exp", "sum"), n=("n", "sum")).reset_index()
        return agg[["qid", "top_sim", "top_id", "sum_exp", "n"]]

    def merge(self, df):
        best = F.min(F.struct((-F.col("top_sim")).alias("neg"), F.col("top_id").alias("tid")))
        return (df.groupBy("qid").agg(best.alias("b"), F.sum("sum_exp").alias("sum_exp"), F.sum("n").alias("n"))
                .select("qid", (-F.col("b.neg")).alias("top_sim"), F.col("b.tid").alias("top_id"), "sum_exp", "n"))


class AdjustedEntropyOp(PairOp):
    """Pass 2: sum over non-top references of p*ln(p + 1e-6) where
    p = (1 - top_sim) * exp(sim) / (sum_exp - exp(top_sim))."""

    schema = "qid long, plogp double"
    query_extra = ("top_sim", "top_id", "sum_exp")

    def partial(self, qids, qmat, extra, refs):
        sims = _unit(qmat) @ _unit(refs.mat).T
        top, top_id, sum_exp = extra["top_sim"], extra["top_id"], extra["sum_exp"]
        z = sum_exp - np.exp(top)
        p = (1.0 - top)[:, None] * np.exp(sims) / z[:, None]
        terms = p * np.log(p + 1e-6)
        terms[refs.ids[None, :] == top_id[:, None]] = 0.0
        return pd.DataFrame({"qid": qids, "plogp": terms.sum(axis=1)})

    def combine(self, pdf):
        return pdf.groupby("qid", sort=False, as_index=False)["plogp"].sum()

    def merge(self, df):
        return df.groupBy("qid").agg(F.sum("plogp").alias("plogp"))


class QuadraticMinOp(PairOp):
    """min over reference rows r of (x - r)^T W (x - r); reference label of the
    minimum (first id on ties).  W is a fixed d x d matrix (broadcast with the
    task closure; its size is d*d*8 bytes)."""

    schema = "qid long, ref_id long, ref_label string, value double"

    def __init__(self, weight: np.ndarray | None):
        self.weight = weight

    def partial(self, qids, qmat, extra, refs):
        rmat = refs.mat
        if self.weight is None:
            d = _sq_dists(qmat, rmat)
            qw, rw = qmat, rmat
        else:
            qw, rw = qmat @ self.weight, rmat @ self.weight
            d = (np.einsum("ij,ij->i", qw, qmat)[:, None] + np.einsum("ij,ij->i", rw, rmat)[None, :]
                 - 2.0 * (qw @ rmat.T))
        best = np.argmin(d, axis=1)
        # exact recomputation for the winners
        diff = qmat - rmat[best]
        dw = diff if self.weight is None else diff @ self.weight
        val = np.einsum("ij,ij->i", dw, diff)
        labels = refs.labels if refs.labels is not None else np.full(len(refs.ids), None, dtype=object)
        return pd.DataFrame({"qid": qids, "ref_id": refs.ids[best], "ref_label": labels[best], "value": val})

    def combine(self, pdf):
        pdf = pdf.sort_values(["qid", "value", "ref_id"], kind="mergesort")
        return pdf.groupby("qid", sort=False).head(1)[["qid", "ref_id", "ref_label", "value"]]

    def merge(self, df):
        best = F.min(F.struct("value", "ref_id", "ref_label"))
        return df.groupBy("qid").agg(best.alias("b")).select("qid", "b.ref_id", "b.ref_label", "b.value")


class DistanceSumOp(PairOp):
    """Per reference, over all queries: sum of the Euclidean distances and number of rows."""

    schema = "ref_label string, s double, n long"

    def partial(self, qids, qmat, extra, refs):
        return pd.DataFrame({"ref_label": refs.labels, "s": np.sqrt(_sq_dists(qmat, refs.mat)).sum(axis=0), "n": len(qids)})

    def combine(self, pdf):
        return pdf.groupby("ref_label", as_index=False).sum()

    def merge(self, df):
        return df.groupBy("ref_label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _prepare(df: DataFrame, extra: tuple[str, ...] = (), label_col: str | None = None) -> DataFrame:
    # fresh aliases: query and reference frames often share lineage (splits of
    # one table); without new attribute ids the cogroup drops the shared column
    cols = [F.col("id").cast("long").alias("id"), F.col("v").alias("v")]
    cols += [F.col(c).alias(c) for c in extra]
    if label_col:
        cols.append(F.col(label_col).cast("string").alias(label_col))
    return df.select(*cols)


def bunches(size: int, block_bytes: int, fewest: int) -> int:
    """Bunches that a side of ``size`` bytes is dealt into: its blocks, or, if they are more than
    ``fewest``, as many as hold ``DEFAULT_BLOCK_BYTES`` (a block is never cut smaller than asked)."""
    return max(1, min(math.ceil(size / block_bytes), max(fewest, math.ceil(size / DEFAULT_BLOCK_BYTES))))


def pair_scan(queries: DataFrame, refs: DataFrame, op: PairOp, *, label_col: str | None = None,
              broadcast_bytes: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """Evaluate ``op`` over all (query, reference) pairs; see module doc."""
    spark = queries.sparkSession
    broadcast_bytes = DEFAULT_BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    block_bytes = block_bytes or DEFAULT_BLOCK_BYTES
    q = _prepare(queries, op.query_extra)
    r = _prepare(refs, (), label_col)
    stats = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n_ref, dim = int(stats["n"]), int(stats["d"] or 0)
    ref_bytes = n_ref * (dim * 8 + 64)
    schema = op.schema

    if ref_bytes <= broadcast_bytes:
        block = RefBlock.from_pandas(r.toPandas(), label_col, op)  # bounded by the size check above
        bc = spark.sparkContext.broadcast(block)

        def scan(batches):
            refs_local = bc.value
            for pdf in batches:
                yield op.run(pdf, refs_local)

        return q.mapInPandas(scan, schema)

    par = spark.sparkContext.defaultParallelism
    if isinstance(op, NearestOp):
        n_blocks = bunches(ref_bytes, block_bytes, FEWEST_BUNCHES) if block_bytes < DEFAULT_BLOCK_BYTES else math.ceil(ref_bytes / SHARED_BLOCK_BYTES)
        return _nearest_shared(q, r, op, label_col, math.ceil(n_ref / n_blocks))
    n_q = q.count()
    n_blocks = bunches(ref_bytes, block_bytes, FEWEST_BUNCHES)
    q_blocks = max(2 * par, bunches(n_q * (dim * 8 + 64), block_bytes, 2 * par))
    # both block keys are int on both sides (cogroup matches keys by value and type)
    qx = (q.withColumn("_qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int"))
          .withColumn("_rb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    rx = (r.withColumn("_rb", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))))

    def cell(qpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        # a cell whose query or reference side is empty arrives without columns
        if len(qpdf) == 0 or len(rpdf) == 0 or "v" not in rpdf.columns or "v" not in qpdf.columns:
            return op.empty()
        return op.run(qpdf, RefBlock.from_pandas(rpdf, label_col, op))

    partials = qx.groupBy("_qb", "_rb").cogroup(rx.groupBy("_qb", "_rb")).applyInPandas(cell, schema)
    return op.merge(partials)


def _nearest_shared(q: DataFrame, r: DataFrame, op: NearestOp, label_col: str | None, rows: int) -> DataFrame:
    """The nearest references, read from the shared folder by each task for its own queries, about
    ``rows`` at a time."""
    spark = q.sparkSession
    files, par = located(written(r, "references")), spark.sparkContext.defaultParallelism
    q = written(q, "queries")
    ids = q.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d")).first()
    schema, step = op.schema, max(1, min(rows, 1 << 14))

    def blocks() -> Iterator[RefBlock]:
        from strayscope.llm import shared_files
        held, n = [], 0
        for uri in files:
            fs, path = shared_files.locate(uri)
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=step, use_threads=False):
                    held.append(batch)
                    n += batch.num_rows
                    if n + step > rows:
                        yield RefBlock.from_pandas(pa.Table.from_batches(held).to_pandas(), label_col, op)
                        held, n = [], 0
        if n:
            yield RefBlock.from_pandas(pa.Table.from_batches(held).to_pandas(), label_col, op)

    def near(mine: pd.DataFrame) -> pd.DataFrame:
        mine = mine[mine["v"].notna()]
        found, known, alone = None, None, not op.by_class and not op.same_label and not op.exclude_self
        for block in blocks():
            part = op.run(mine, block, known)
            found = part if found is None or not len(found) else op.combine(pd.concat([found, part], ignore_index=True)) if len(part) else found
            if alone and len(found):
                last = found[found["rank"] == op.k]
                known = mine["id"].map(pd.Series(last["value"].to_numpy(), index=last["qid"].to_numpy())).to_numpy(np.float64)
                known = np.where(np.isnan(known), op.farthest(), known)
        return op.empty() if found is None else found

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= SHARED_QUERIES:
                yield near(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield near(pd.concat(held, ignore_index=True))

    q = q.repartition(par, "id") if q.rdd.getNumPartitions() < par else q
    found = q.mapInPandas(scan, schema)
    return found if ids["n"] == ids["d"] else op.merge(found)
