"""Settings of an archive and their checks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Presets as (base level, quality level, buffer in MB).
PRESETS = {0: (0, 0, 8), 1: (2, 2, 64), 2: (3, 2, 256)}


@dataclass(frozen=True)
class Options:
    """Archive settings; an offset of 0 means that it is inferred."""

    dna_level: int = 2
    quality_level: int = 2
    buffer_mb: int = 64
    quality_offset: int = 0
    lossy: bool = False
    crc32: bool = False
    fields: tuple[int, ...] = field(default_factory=tuple)
    plus_repetition: bool = False
    color_space: bool = False
    threads: int = 8
    verbose: bool = False

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(0 <= self.dna_level <= 3, "dna_level must be 0 to 3")
        need(0 <= self.quality_level <= 2, "quality_level must be 0 to 2")
        need(1 <= self.buffer_mb <= 1024, "buffer_mb must be 1 to 1024")
        need(self.quality_offset == 0 or 33 <= self.quality_offset <= 64, "quality_offset must be 0 or 33 to 64")
        need(1 <= self.threads <= 64, "threads must be 1 to 64")
        need(all(f >= 1 for f in self.fields), "fields are numbered from 1")

    @classmethod
    def preset(cls, level: int, **more) -> Options:
        if level not in PRESETS:
            raise ValueError("preset must be 0 to 2")
        dna, quality, buffer_mb = PRESETS[level]
        return replace(cls(dna, quality, buffer_mb), **more)

    @property
    def dna_order(self) -> int:
        return self.dna_level * 3

    @property
    def quality_order(self) -> int:
        return self.quality_level * (3 if self.lossy else 1)

    @property
    def check_tag(self) -> bool:
        return self.crc32 and not self.fields

    @property
    def check_quality(self) -> bool:
        return self.crc32 and not self.lossy

    @property
    def base_coder(self) -> str:
        """Coder of the bases: static codes at order 0, adaptive contexts above."""
        return "static" if self.dna_order == 0 else "order"

    @property
    def quality_coder(self) -> str:
        """Processor of the qualities: scores as they are or in 8 bins, static codes at order 0 and adaptive contexts above."""
        return ("lossy" if self.lossy else "lossless") + ("_static" if self.quality_order == 0 else "_order")
