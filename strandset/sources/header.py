"""Headers of alignment files, as lists of (kind, fields)."""

from __future__ import annotations

from dataclasses import dataclass, field

# What duplicate marking writes about itself.
PROGRAM = "MarkDuplicates"
VERSION = "1.6"


@dataclass
class Header:
    """lines: (kind, fields by tag) in file order, comments as ("CO", {"": text}). references: (name, length)."""

    lines: list[tuple[str, dict[str, str]]] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Header:
        found = []
        for line in filter(None, text.replace("\0", "").split("\n")):
            kind, _, rest = line.rstrip("\r").partition("\t")
            if not kind.startswith("@"):
                raise ValueError(f"not a header line: {line[:50]!r}")
            fields = {"": rest} if kind == "@CO" else dict(x.split(":", 1) for x in rest.split("\t") if x)
            found.append((kind[1:], fields))
        return Header(found)

    def render(self) -> str:
        return "".join(f"@{kind}\t" + (fields[""] if kind == "CO" else "\t".join(f"{k}:{v}" for k, v in fields.items())) + "\n" for kind, fields in self.lines)

    def of(self, kind: str) -> list[dict[str, str]]:
        return [fields for k, fields in self.lines if k == kind]

    @property
    def references(self) -> list[tuple[str, int]]:
        return [(x["SN"], int(x["LN"])) for x in self.of("SQ")]

    @property
    def sort_order(self) -> str | None:
        return next((x.get("SO") for x in self.of("HD")), None)

    def sorted_by(self, order: str) -> Header:
        """This header with another sort order."""
        first = next((f for k, f in self.lines if k == "HD"), {"VN": VERSION})
        return Header([("HD", dict(first) | {"SO": order}), *[x for x in self.lines if x[0] != "HD"]])

    def library_names(self) -> list[str | None]:
        return [x.get("LB") for x in self.of("RG")]

    def libraries(self, unknown: str) -> list[tuple[str, int]]:
        """(read group, number of its library), libraries numbered in order of appearance."""
        numbers: dict[str, int] = {}
        return [(x["ID"], numbers.setdefault(x.get("LB", unknown), len(numbers))) for x in self.of("RG")]

    def check_sort_order(self, assumed: str | None = None) -> None:
        if assumed is not None:
            if assumed != "coordinate":
                raise ValueError(f"cannot assume sort order {assumed!r}: only coordinate")
            return
        order = self.sort_order
        if order == "coordinate":
            return
        reasons = {None: "the header names no sort order", "queryname": "the file is sorted by name", "unsorted": "the file is not sorted"}
        raise ValueError(reasons.get(order, f"unknown sort order {order!r}") + "; coordinate order is needed")

    def marked(self, version: str, command: str) -> Header:
        """The header of marked output: @HD with version and sort order only, and a program line at the chain's end. A
        program of that name gets a number behind it, so that ids stay unique."""
        order = {"SO": self.sort_order} if self.sort_order else {}
        rest = [(k, dict(f)) for k, f in self.lines if k != "HD"]
        programs = self.of("PG")
        used, parents = {x.get("ID") for x in programs}, {x.get("PP") for x in programs}
        name, n = PROGRAM, 0
        while name in used:
            n += 1
            name = f"{PROGRAM}.{n}"
        leaves = [x["ID"] for x in programs if x.get("ID") not in parents]
        line = {"ID": name, "PN": PROGRAM, "VN": version} | ({"PP": leaves[-1]} if leaves else {}) | {"CL": command}
        return Header([("HD", {"VN": VERSION} | order), *rest, ("PG", line)])
