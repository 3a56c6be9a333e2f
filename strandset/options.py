"""Options of duplicate marking."""

from __future__ import annotations

import re
from dataclasses import dataclass


def check_tag(tag: str | None) -> str | None:
    """An auxiliary tag's name: a letter, then a letter or digit."""
    if tag is not None and not re.fullmatch(r"[A-Za-z][A-Za-z0-9]", tag):
        raise ValueError(f"not a tag name: {tag!r}")
    return tag


@dataclass(frozen=True)
class Options:
    """closing: "set" groups all pairs of a key; "stream" lets a group close as a one-pass reader would (see streaming)."""

    barcode_tag: str | None = None
    read_one_tag: str | None = None
    read_two_tag: str | None = None
    molecular_id_tag: str | None = None
    remove_duplicates: bool = False
    assume_sort_order: str | None = None
    closing: str = "set"

    def __post_init__(self) -> None:
        for tag in (self.barcode_tag, self.read_one_tag, self.read_two_tag, self.molecular_id_tag):
            check_tag(tag)
        if self.molecular_id_tag and not self.barcode_tag:
            raise ValueError("a molecular identifier tag needs a barcode tag")
        if self.closing not in ("set", "stream"):
            raise ValueError(f"unknown closing {self.closing!r}")
        if self.assume_sort_order not in (None, "coordinate"):
            raise ValueError(f"cannot assume sort order {self.assume_sort_order!r}: only coordinate")
