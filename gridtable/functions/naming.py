"""Names of chunks: r<row bucket>, c<column group>, h<hash buckets>, rg<range buckets>, v<version>."""

from __future__ import annotations

import re
from dataclasses import dataclass

from gridtable.errors import InvalidChunkNameError

PART = re.compile(r"(rg|r|c|h|v)([0-9]+(?:-[0-9]+)*)")


@dataclass(frozen=True)
class Chunk:
    """Where rows lie: the bucket of their ids, the column group, and their buckets along the other axes."""

    row_bucket: int
    col_group: int = 0
    hash_buckets: tuple[int, ...] = ()
    range_buckets: tuple[int, ...] = ()
    version: int = 0

    @property
    def row_key(self) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        """What chunks of the same rows share, whatever their column group and version."""
        return self.row_bucket, self.hash_buckets, self.range_buckets


def format_chunk(chunk: Chunk) -> str:
    parts = ["chunk", f"r{chunk.row_bucket}", f"c{chunk.col_group}"]
    if chunk.hash_buckets:
        parts.append("h" + "-".join(map(str, chunk.hash_buckets)))
    if chunk.range_buckets:
        parts.append("rg" + "-".join(map(str, chunk.range_buckets)))
    return "_".join([*parts, f"v{chunk.version}"]) + ".parquet"


def parse_chunk(name: str) -> Chunk:
    head, *parts = name.removesuffix(".parquet").split("_")
    values: dict[str, tuple[int, ...]] = {}
    for part in parts:
        m = PART.fullmatch(part)
        if not m or m[1] in values:
            raise InvalidChunkNameError(name)
        values[m[1]] = tuple(map(int, m[2].split("-")))
    one = [values.get(k, ()) for k in ("r", "c", "v")]
    if head != "chunk" or not name.endswith(".parquet") or any(len(v) != 1 for v in one):
        raise InvalidChunkNameError(name)
    return Chunk(one[0][0], one[1][0], values.get("h", ()), values.get("rg", ()), one[2][0])


def chunk_path(base: str, table: str, chunk: Chunk) -> str:
    return f"{base.rstrip('/')}/{table}/chunks/{format_chunk(chunk)}"
