"""What a run is asked to do, checked on the driver before any plan is built."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

TABLE_MODES = ("structured", "auto", "image-only")
OCR_MODES = ("auto", "on", "off")


class LeafmillError(Exception):
    """Anything this package raises itself."""


class FeatureMissing(LeafmillError):
    """A run needs an engine (conversion, recognition, captions) that was not given."""


@dataclass(frozen=True)
class Options:
    """tables: what becomes of tables; ocr: which pages are recognised; captions: whether images are described."""

    tables: str = "auto"
    ocr: str = "auto"
    captions: bool = False
    ocr_threshold: float = 0.05
    table_confidence: float = 0.6
    pages: tuple[int, ...] | None = None
    scope: str = "leafmill"
    repair: bool = True
    compat: bool = True

    def __post_init__(self) -> None:
        if self.tables not in TABLE_MODES:
            raise ValueError(f"tables must be one of {', '.join(TABLE_MODES)}, not {self.tables!r}")
        if self.ocr not in OCR_MODES:
            raise ValueError(f"ocr must be one of {', '.join(OCR_MODES)}, not {self.ocr!r}")
        if self.pages is not None and any(p < 1 for p in self.pages):
            raise ValueError("page numbers begin at 1")

    def to_dict(self) -> dict:
        return asdict(self)


#: What a module id is: ASCII letters, digits, hyphens and underscores, at least one letter or digit among them.
MODULE_ID = "^[-_]*[A-Za-z0-9][-_A-Za-z0-9]*$"


def module_id_is_valid(module: str) -> bool:
    return re.fullmatch(MODULE_ID[1:-1], module) is not None
