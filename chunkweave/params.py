"""Parameters of the engine, and their JSON files."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import TypeVar

#: Fixed values of the stored formats: bytes a container may hold, of its metadata, and of their parts.
CONTAINER_BYTES, META_BYTES = 4 * 1024 * 1024, 1024 * (32 + 24 + 8)
FP_BYTES, FEATURE_BYTES, IV_BYTES, ADDRESS_BYTES = 32, 24, 16, 16

T = TypeVar("T")


def gear_table(seed: str = "chunkweave") -> tuple[int, ...]:
    """256 even 32-bit numbers, one a byte, from a rule; give another table to ChunkParams to cut as other tools do."""
    return tuple(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "little") for i in range(256))


@dataclasses.dataclass(frozen=True)
class ChunkParams:
    method: str = "fastcdc"  # or "fixed"
    min: int = 4096
    avg: int = 8192
    max: int = 16384
    block: int = 128 * 1024 * 1024
    gear: tuple[int, ...] = dataclasses.field(default_factory=gear_table)

    def __post_init__(self):
        if self.method == "fastcdc" and not 0 < self.min <= self.avg <= self.max:
            raise ValueError("chunk sizes must be 0 < min <= avg <= max")
        if len(self.gear) != 256:
            raise ValueError("a gear table has 256 numbers")


@dataclasses.dataclass(frozen=True)
class SegmentParams:
    min_bytes: int = 5 * 1024 * 1024
    max_bytes: int = 20 * 1024 * 1024
    max_chunks: int = 10_000
    divisor: int = 640
    pattern: int = 1


@dataclasses.dataclass(frozen=True)
class PackParams:
    container_bytes: int = CONTAINER_BYTES
    meta_bytes: int = META_BYTES


@dataclasses.dataclass(frozen=True)
class SparseParams:
    sample_bits: int = 6
    champions: int = 10
    manifests: int = 10


@dataclasses.dataclass(frozen=True)
class FrequencyParams:
    depth: int = 4
    width: int = 256 * 1024
    top: int = 512 * 1024
    batch: int = 128


@dataclasses.dataclass(frozen=True)
class SyncParams:
    chunks: ChunkParams = dataclasses.field(default_factory=ChunkParams)
    pack: PackParams = dataclasses.field(default_factory=PackParams)
    segments: SegmentParams = dataclasses.field(default_factory=SegmentParams)
    sparse: SparseParams = dataclasses.field(default_factory=SparseParams)
    batch: int = 128
    codec: str = "zstd"
    lanes: int = 64


def from_json(kind: type[T], text: str) -> T:
    """Parameters from a JSON object; nested ones from nested objects. Unknown names are errors."""
    return _built(kind, json.loads(text))


def _built(kind, values: dict):
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    nested = {"chunks": ChunkParams, "pack": PackParams, "segments": SegmentParams, "sparse": SparseParams}
    return kind(**{k: _built(nested[k], v) if isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def to_json(params) -> str:
    return json.dumps(dataclasses.asdict(params))
