"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is hashed to a wide vector, and a text's fingerprint is the sum
of its paragraphs' vectors, each lane modulo 2^16. The order of paragraphs does
not matter, and paragraphs are put in or taken out by adding or subtracting
their vectors, without the rest of the text. SECURE lanes are uniform digits of
a digest of the paragraph: these tell different multisets apart. The other
lanes count the paragraph's grams of GRAM bytes with a sign, each in a lane
that its hash picks, so that the cosine of two fingerprints estimates the
cosine of their texts' counts of grams, give or take one over the root of
LIKE lanes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import cut

#: Lanes of 16 bits: uniform ones for equality, signed counts for likeness.
SECURE, LIKE = 64, 256
#: Bytes of a gram; a shorter paragraph is one gram by itself.
GRAM = 12
#: Windows that are hashed at once, which bounds the memory of a very long text.
AT_ONCE = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def paragraphs(text: bytes) -> list[bytes]:
    """The lines of a text, blank ones included; none of an empty text."""
    return text.split(b"\n") if text else []


def _secure(parts: list[bytes]) -> np.ndarray:
    """Sum of the uniform lanes."""
    total = np.zeros(SECURE, np.uint16)
    for lo in range(0, len(parts), 4096):
        raw = b"".join(d for p in parts[lo : lo + 4096] for d in (hashlib.blake2b(p, person=b"0").digest(), hashlib.blake2b(p, person=b"1").digest()))
        total += np.frombuffer(raw, "<u2").reshape(-1, SECURE).sum(axis=0, dtype=np.uint16)
    return total


def _lanes(hashes: np.ndarray) -> np.ndarray:
    signs = ((hashes >> np.uint64(20)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return np.bincount((hashes >> np.uint64(32)) % np.uint64(LIKE), signs, LIKE).astype(np.int64)


def _counts(parts: list[bytes]) -> np.ndarray:
    """Signed counts of the grams of the paragraphs; no gram crosses from one paragraph to the next."""
    total = np.zeros(LIKE, np.int64)
    short = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little") for p in parts if 0 < len(p) < GRAM]
    if short:
        total += _lanes(np.array(short, np.uint64))
    joined = b"\n".join(p for p in parts if len(p) >= GRAM)
    for lo in range(0, max(0, len(joined) - GRAM + 1), AT_ONCE):
        raw = np.frombuffer(joined[lo : lo + AT_ONCE + GRAM - 1], np.uint8)
        n = len(raw) - GRAM + 1
        head = np.lib.stride_tricks.sliding_window_view(raw, 8)[:n].copy().view(np.uint64)[:, 0]
        tail = np.lib.stride_tricks.sliding_window_view(raw[GRAM - 8 :], 8)[:n].copy().view(np.uint64)[:, 0]
        mixed = (head * _A) ^ (tail * _B)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _A
        breaks = np.concatenate([[0], np.cumsum(raw == 10)])
        total += _lanes(mixed[breaks[GRAM:] == breaks[:n]])
    return total


def vector(parts: list[bytes]) -> np.ndarray:
    """Sum of the vectors of paragraphs, lane by lane modulo 2^16."""
    return np.concatenate([_secure(parts), _counts(parts).astype(np.uint16)])


def insert(of: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """A fingerprint with paragraphs put in, wherever they stand."""
    return of + vector(parts)


def delete(of: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """A fingerprint with paragraphs taken out."""
    return of - vector(parts)


def fingerprint(text: bytes) -> np.ndarray:
    """The fingerprint of a whole text; all lanes are 0 for an empty one."""
    return vector(paragraphs(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated cosine of the counts of grams, 0 to 1; 1 for equal fingerprints, 0 beside an empty text."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[SECURE:].view(np.int16).astype(float) for v in (a, b))
    size = float(x @ x) * float(y @ y)
    return float(min(1.0, max(0.0, float(x @ y) / size**0.5))) if size else 0.0


def edited(text: str, other: str) -> tuple[str, int]:
    """The text with its last half replaced by as much of the beginning of the other one; and how much stays."""
    stays = len(text) - len(text) // 2
    return text[:stays] + other[: len(text) // 2], stays


class _Document:
    """A row on its way through: its text, and the fingerprint of what an edit leaves and of the rest."""

    def __init__(self, id_, text: bytes):
        self.id, self.raw, self.rows = id_, text, 1
        self.text = text.decode("utf-8", "replace")
        stays = self.text[: len(self.text) - len(self.text) // 2].encode()
        #: Paragraphs before the one that the edit reaches into stay as they are.
        self.whole = stays.rfind(b"\n") + 1
        parts = paragraphs(self.text.encode())
        kept = stays.count(b"\n")
        self.kept = vector(parts[:kept])
        self.all = insert(self.kept, parts[kept:])

    def row(self, after: _Document) -> tuple:
        """Its figures, given the next document. The edited fingerprint takes the new paragraphs in, the kept ones are not read again."""
        made = edited(self.text, after.text)[0].encode()
        changed = insert(self.kept, made[self.whole :].split(b"\n") if made else [])
        return (self.id, len(self.text), hashlib.sha256(made).hexdigest(), self.all.tobytes().hex(), changed.tobytes().hex(), likeness(self.all, changed), likeness(self.all, after.all))


def _bounds(docs: DataFrame, pieces: int, order: list[str]) -> DataFrame:
    """One row with the least (id, mark) of each piece in order: one value a piece, of a range partitioning of the ids alone."""
    dealt = docs.select(*order).repartitionByRange(pieces, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("least"))
    return cut(dealt.select("least")).agg(F.sort_array(F.collect_list("least")).alias("bounds"))


def _piece(bounds: Column, at: Column, steps: int) -> Column:
    """Number of bounds up to a value, by bisection."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= F.size(bounds)) & (F.try_element_at(bounds, n + p) <= at), n + p).otherwise(n))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is that of the next id, after the last one the first;
    documents without id come before all others, those of equal id in the
    order of a hash of their texts. Rows that share id and text are one
    document and get equal figures. A null text is an empty one, whose lanes
    are all 0; a document alone is its own next one. An empty table gives no
    rows; other columns are not looked at.

    Texts are shuffled once, by ranges of the order; the first document of a
    range goes to the range before it, too. Within a range texts stream by, two
    at a time.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    pieces = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    rows = rows.crossJoin(F.broadcast(_bounds(rows, pieces, ["id", "mark"])))  # one row, a value for each piece
    at, n = F.struct("id", "mark"), F.size("bounds")
    rows = rows.withColumn("piece", _piece(F.col("bounds"), at, pieces.bit_length()))
    first = F.element_at("bounds", F.col("piece")) == at
    before = F.when(F.col("piece") == 1, n).otherwise(F.col("piece") - 1)
    own = F.struct((F.col("piece") - 1).alias("to"), F.lit(False).alias("ghost"))
    ghost = F.struct((before - 1).alias("to"), F.lit(True).alias("ghost"))
    dealt = rows.select("id", "mark", F.col("text").cast("binary").alias("text"), F.explode(F.when(first, F.array(own, ghost)).otherwise(F.array(own))).alias("x"))
    dealt = dealt.select("id", "mark", "text", "x.*").repartitionById(pieces, "to").sortWithinPartitions("ghost", "id", "mark", "text")
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done, kinds = None, False, None

        def made(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            found: list[tuple] = []
            for id_, raw, ghost in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if done:
                    break
                id_, raw, ghost = id_.as_py(), raw.as_py(), ghost.as_py()
                if last is not None and not ghost and (id_, raw) == (last.id, last.raw):
                    last.rows += 1
                    continue
                now = _Document(id_, raw)
                if last is not None:
                    row = last.row(now)
                    while last.rows:
                        found.append(row)
                        last.rows -= 1
                        if len(found) == 4096:
                            yield made(found)
                            found = []
                last, done = now, ghost
            yield made(found)

    return dealt.select("id", "text", "ghost").mapInArrow(run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def op13_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
