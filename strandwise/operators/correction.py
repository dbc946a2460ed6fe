"""Running a corrector over reads: broadcast arrays of the solid set, Arrow batches in and out."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.config import Settings
from strandwise.functions import kmers as fk

from .kernels.conservative import Corrector as ConservativeCorrector
from .kernels.lookup import SolidSet
from .kernels.paths import ConsensusCorrector, ScoredCorrector


def solid_set(solid: DataFrame, k: int, most_bytes: int = 2 << 30) -> SolidSet:
    """The solid set as arrays for a broadcast, after a check of its size (9 bytes for each k-mer)."""
    kept = solid.select(fk.pack_left("kmer", clean=True).alias("p"), F.col("m").cast("int").alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = kept.count()
        if rows * 9 > most_bytes:
            raise ValueError(f"{rows} solid k-mers take more than {most_bytes} bytes; raise the threshold or max_solid_bytes")
        packed = kept.toArrow()
    finally:
        kept.unpersist()
    left = packed.column("p").to_numpy().astype(np.int64).view(np.uint64)
    return SolidSet(left >> np.uint64(64 - 2 * k) if k < 32 else left, packed.column("m").to_numpy(), k)


class Algorithm(ABC):
    """What a corrector must offer to be registered and run over reads."""

    #: The status of reads that settled() marks.
    SETTLED = "unchanged"

    @abstractmethod
    def correct(self, bases: str, quals: str) -> tuple[str, str, str]:
        """(bases, quals, status) of one read."""

    def settled(self, bases: pa.Array) -> np.ndarray:
        """Which reads of a batch correct() would give back as they are; none, unless a corrector can tell."""
        return np.zeros(len(bases), bool)

    def correct_many(self, reads: list[tuple[str, str]]) -> list[tuple[str, str, str]]:
        """correct() of many reads; one by one, unless a corrector has a faster way."""
        return [self.correct(*x) for x in reads]


#: name -> (solid, threshold, settings, qs_offset, qs_cutoffs) -> Algorithm
REGISTRY: dict[str, Callable[..., Algorithm]] = {}


def algorithm(name: str):
    """Register a maker of correctors by name."""

    def register(make):
        REGISTRY[name.lower()] = make
        return make

    return register


@algorithm("conservative")
def conservative(solid, threshold, settings, qs_offset, qs_cutoffs):
    return ConservativeCorrector(solid, threshold, settings.conservative)


@algorithm("consensus")
def consensus(solid, threshold, settings, qs_offset, qs_cutoffs):
    return ConsensusCorrector(solid, settings.consensus, qs_offset, *qs_cutoffs)


@algorithm("scored")
def scored(solid, threshold, settings, qs_offset, qs_cutoffs):
    return ScoredCorrector(solid, settings.scored, qs_offset)


for _known in (ConservativeCorrector, ConsensusCorrector, ScoredCorrector):
    Algorithm.register(_known)


def corrector(name: str, solid: SolidSet, threshold: int, settings: Settings, qs_offset: int = 33, qs_cutoffs: tuple[int, int] = (0, 0)) -> Algorithm:
    if name.lower() not in REGISTRY:
        raise ValueError(f"no algorithm {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name.lower()](solid, threshold, settings, qs_offset, qs_cutoffs)


def correct(reads: DataFrame, kernel: Algorithm, held: list | None = None) -> DataFrame:
    """reads (read_id, name, bases, quals, ...) with corrected bases and quals, plus n_corrections and status.

    n_corrections counts the positions that differ (0 if the read was trimmed). One pass, no shuffle.
    Reads that the corrector would give back as they are, by their solid windows alone, are found for
    a whole batch at once; only the others are walked one by one. The broadcast is added to `held`,
    for the caller to unpersist once the result has been written.
    """
    shared = reads.sparkSession.sparkContext.broadcast(kernel)
    if held is not None:
        held.append(shared)
    names = reads.columns
    b, q = names.index("bases"), names.index("quals")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            bases, quals, changed, status = [], [], [], []
            rows = list(zip(batch.column(b).to_pylist(), batch.column(q).to_pylist(), own.settled(batch.column(b)).tolist()))
            left = [i for i, (old, qual, done) in enumerate(rows) if not done or len(old) != len(qual or "")]
            many = getattr(own, "correct_many", None) or (lambda some: [own.correct(*x) for x in some])
            fixed = dict(zip(left, many([(rows[i][0] or "", rows[i][1] or "") for i in left])))
            for i, (old, qual, _) in enumerate(rows):
                new, new_qual, said = fixed[i] if i in fixed else (old, qual, own.SETTLED)
                bases.append(new)
                quals.append(new_qual)
                changed.append(sum(x != y for x, y in zip(old, new)) if old and len(old) == len(new) and old != new else 0)
                status.append(said)
            columns = list(batch.columns)
            columns[b], columns[q] = pa.array(bases, pa.string()), pa.array(quals, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(changed, pa.int32()), pa.array(status, pa.string())], [*names, "n_corrections", "status"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)
    return reads.mapInArrow(run, f"{fields}, n_corrections int, status string")
