"""Field extraction from XML: Spark's own functions for texts, one parse for everything else."""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from doccat.operators.scale import ship_code

# Where each field sits in a metadata record.
FIELD_PATHS = {
    "title": "//dataIdInfo//resTitle",
    "class": "//title",
    "partner": "//dataIdInfo//rpXTPartName",
    "service": "//dataIdInfo//rpOrgName",
    "abstract": "//dataIdInfo//idAbs",
}
THEME_PATH = "//dataIdInfo//tpCat//descXT"
ATTRIBUTE_PATH = "//eainfo//attr"
ATTRIBUTE_LABEL = "attrlabl"
ATTRIBUTE_DESCRIPTION = "atXTdesc"

class _Collector:
    """Text of the elements that paths such as ``//a//b`` match, in one pass over a record.

    ``texts`` has all text of the matches of a path joined, ``lists`` one string per match, and
    ``pairs`` per match the text of two kinds of elements inside. Nested text counts. Elements are
    matched by local name, whatever their prefix.
    """

    def __init__(self, texts: list[str], lists: list[str], pairs: list[tuple[str, str, str]]):
        def names(path: str) -> tuple[str, ...]:
            return tuple(path.strip("/").split("//"))

        self.paths = [names(p) for p in [*texts, *lists, *(p for p, _, _ in pairs)]]
        self.n_texts, self.n_lists = len(texts), len(lists)
        self.inside = [(label, description) for _, label, description in pairs]
        self.open: list[str] = []
        self.joined: list[list[str]] = [[] for _ in texts]
        self.found: list[list[list]] = [[] for _ in [*lists, *pairs]]
        # Per path the matches that are open, with their depth; pairs also have open parts.
        self.active: list[list[tuple[int, object]]] = [[] for _ in self.paths]
        self.parts: list[tuple[int, list[str]]] = []

    def start(self, name: str, attributes) -> None:
        local = name.rpartition(":")[2]
        for k, path in enumerate(self.paths):
            if local == path[-1] and self._under(path[:-1]):
                item = None
                if k >= self.n_texts:
                    item = [] if k < self.n_texts + self.n_lists else ([], [])
                    self.found[k - self.n_texts].append(item)
                self.active[k].append((len(self.open), item))
        for k, (label, description) in enumerate(self.inside):
            for _, item in self.active[self.n_texts + self.n_lists + k]:
                if local == label:
                    self.parts.append((len(self.open), item[0]))
                if local == description:
                    self.parts.append((len(self.open), item[1]))
        self.open.append(local)

    def _under(self, names: tuple[str, ...]) -> bool:
        rest = iter(self.open)
        return all(n in rest for n in names)

    def end(self, name: str) -> None:
        self.open.pop()
        depth = len(self.open)
        for matches in self.active:
            if matches and matches[-1][0] == depth:
                matches.pop()
        while self.parts and self.parts[-1][0] == depth:
            self.parts.pop()

    def text(self, data: str) -> None:
        for k, matches in enumerate(self.active):
            if matches:
                if k < self.n_texts:
                    self.joined[k].append(data)
                elif k < self.n_texts + self.n_lists:
                    for _, item in matches:
                        item.append(data)
        for _, part in self.parts:
            part.append(data)


def read_record(
    xml: str | None, texts: list[str], lists: list[str], pairs: list[tuple[str, str, str]]
) -> tuple[str | None, list[str], list[list]]:
    """Why the record is not well-formed (None if it is), joined texts, items of lists and pairs."""
    if xml is None:
        return "no text", [], []
    found = _Collector(texts, lists, pairs)
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = found.start
    parser.EndElementHandler = found.end
    parser.CharacterDataHandler = found.text
    try:
        parser.Parse(xml.encode() if xml.startswith("\ufeff") else xml, True)
    except expat.ExpatError as error:
        return str(error), [], []
    items = [
        [tuple("".join(part) for part in x) if isinstance(x, tuple) else "".join(x) for x in each]
        for each in found.found
    ]
    return None, ["".join(x) for x in found.joined], items


def is_well_formed(xml: Column) -> Column:
    """``xpath`` fails a whole job on one malformed record, so records are checked first."""
    parsed = F.from_xml(
        xml,
        "_broken STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"},
    )
    return xml.isNotNull() & parsed["_broken"].isNull()


def xml_text(xml: Column, path: str) -> Column:
    """Text of all matches joined with no separator, nested elements included."""
    return F.array_join(F.xpath(xml, F.lit(f"{path}//text()")), "")


def xml_list(xml: Column, path: str) -> Column:
    """One string per match with its nested text; an empty match gives ``""``.

    ``xpath`` has no list of strings per element, so the record is parsed by an Arrow function. Null
    where the record is not well-formed.
    """
    ship_code(SparkSession.active())

    @F.arrow_udf("array<string>")
    def items(records: pa.Array) -> pa.Array:
        read = (read_record(x, [], [path], []) for x in records.to_pylist())
        return pa.array([None if why else found[0] for why, _, found in read], pa.list_(pa.string()))

    return items(F.try_validate_utf8(xml))


def xml_pairs(
    xml: Column,
    path: str = ATTRIBUTE_PATH,
    label: str = ATTRIBUTE_LABEL,
    description: str = ATTRIBUTE_DESCRIPTION,
) -> Column:
    """``array<struct<label, description>>``, one per match; a missing part is ``""``.

    Two separate ``xpath`` lists would drop the missing parts and shift the pairs.
    """
    ship_code(SparkSession.active())
    kind = pa.list_(pa.struct([("label", pa.string()), ("description", pa.string())]))

    @F.arrow_udf("array<struct<label string, description string>>")
    def items(records: pa.Array) -> pa.Array:
        read = (read_record(x, [], [], [(path, label, description)]) for x in records.to_pylist())
        rows = [
            None if why else [{"label": a, "description": b} for a, b in found[0]] for why, _, found in read
        ]
        return pa.array(rows, kind)

    return F.transform(
        items(F.try_validate_utf8(xml)), lambda x: F.struct(F.upper(x["label"]).alias("label"), x["description"].alias("description"))
    )
