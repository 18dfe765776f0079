"""Near copies by circulant MinHash.

Two permutations give all coordinates of a signature: the first deals shingles to places, the second ranks the places, and
coordinate k is the least rank of a document's places when all are shifted by k. So a shingle's ranks for all coordinates
are one stretch of the second permutation, and a signature is the minimum of such stretches. Coordinates are cut into
bands; documents that share a band are candidates and are compared on their whole sets, unless wide parity sketches, with
16 bits or more for each shingle, show already that they differ in too many: they never show too much.

Bands are set by the similarity so that a link is missed with a probability of at most about ``MISSED``: the longest bands
are taken of which enough fit ``COORDINATES``. Nothing is capped: the documents of a band are compared
with its smallest and largest one and, as far as they are still apart, with each other (see ``parity``, whose groups,
components and verification these are). Places are ``PLACES`` in number; shingles that fall to one make sets no less alike.

Defined results: null or empty text, or text without words, has the empty set and no link; a text of fewer words than a
shingle is one shingle; rows with one id are one document; rows with a null id are left out; other columns, whatever their
names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import parity
from marlstone.llm.batches import mixed

#: Coordinates of a signature at most; the probability that a link is missed; places; rows of ranks gathered at a time.
COORDINATES, MISSED, PLACES, AT_ONCE = 400, 1e-8, 1 << 20, 2048


def layout(percent: int) -> tuple[int, int]:
    """(bands, coordinates of each) for links of this similarity."""
    best = None
    for size in range(1, COORDINATES + 1):
        share = (percent / 100) ** size
        bands = 1 if share >= 1 else math.ceil(math.log(MISSED) / math.log1p(-share))
        if best is None or bands * size <= COORDINATES:
            best = bands, size
        if bands * size > COORDINATES:
            break
    return best


@functools.cache
def _ranks(size: int) -> np.ndarray:
    """Row p: the ranks of the places from p on, for each shift. The rows overlap, so there is one permutation in memory."""
    order = np.random.default_rng(20240611).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: size - 1]]), size)


def signatures(flat: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` coordinates for each set of shingle hashes; of empty sets all are the largest number."""
    ranks, places = _ranks(size), (mixed(flat ^ np.uint64(0xC3A5C85C97CB3127)) & np.uint64(PLACES - 1)).astype(np.int64)
    out = np.full((len(ends), size), np.iinfo(np.uint32).max, dtype=np.uint32)
    begin = 0
    for i, end in enumerate(ends.tolist()):
        for at in range(begin, end, AT_ONCE):
            np.minimum(out[i], ranks[places[at : min(end, at + AT_ONCE)]].min(axis=0), out=out[i])
        begin = end
    return out


class Circulant(parity.Parity):
    """Candidates by bands of circulant signatures, bounded by parity sketches that are wide enough to be near exact."""

    counted = False

    def __init__(self, percent: int):
        super().__init__(percent)
        self.bands, self.width = layout(percent)
        self.size = self.bands * self.width

    def keys(self, flat: np.ndarray, ends: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(np.diff(ends, prepend=0))
        found = signatures(flat, ends, self.size)[own].astype(np.uint64)
        # Neighbouring coordinates go to different bands.
        cut = found.reshape(len(own), self.width, self.bands)
        keys = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) << np.uint64(40), (len(own), self.bands))
        for j in range(self.width):
            keys = mixed(keys * np.uint64(0x9FB21C651E98DF25) + cut[:, j])
        counts = np.zeros(len(ends), dtype=np.int64)
        counts[own] = self.bands
        return keys.ravel(), counts


def near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: of the documents that links connect the first is kept."""
    groups = parity.linked_components(docs, shingle, percent, doc_id, text, Circulant(percent))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2, 80)


def oracle(shingle: int, percent: int) -> str:
    n, p = shingle, percent
    return rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[p:p + {n - 1}], ' ')) as g from (select doc_id, w, unnest(generate_series(1, len(w) - {n - 1})) as p from d where len(w) >= {n})
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and {n - 1}
),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= {p} * (x.n + y.n - shared)),
reach(doc_id, node) as (select doc_id, doc_id from d union select r.doc_id, l.b from reach r join links l on r.node = l.a)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(node) as component_id, r.doc_id = min(node) as kept from reach r left join n on n.doc_id = r.doc_id group by r.doc_id
"""


ORACLE = oracle(2, 80)
