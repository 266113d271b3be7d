"""Bytes of XML records to text, by byte-order mark or declared encoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from doccat.operators.scale import ship_code

# First bytes that tell the encoding, byte-order marks first, longer ones before shorter ones.
MARKS = {"0000FEFF": "utf-32be", "FFFE0000": "utf-32le", "EFBBBF": "utf-8", "FEFF": "utf-16be", "FFFE": "utf-16le"}
UNMARKED = {"0000003C": "utf-32be", "3C000000": "utf-32le", "003C003F": "utf-16be", "3C003F00": "utf-16le"}
# Names of the encodings that Spark's own functions decode here.
UTF8 = ("utf-8", "utf8")
LATIN1 = ("iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "latin-1", "l1")
ASCII = ("us-ascii", "ascii")
# Bytes in which an XML declaration has to end.
HEAD = 4096
DECLARED = r"""^<\?xml\s[^>]*?encoding\s*=\s*["']([A-Za-z][A-Za-z0-9._:-]*)["']"""
# Encodings with more than one byte a character, whose declaration cannot be read as single bytes.
WIDE = r"^(utf|ucs|iso-10646-ucs)[-_]?(16|32|2|4)"


def xml_encoding(content: Column) -> Column:
    """The encoding of an XML record in lower case: by its first bytes, else as declared, else UTF-8."""
    first = F.hex(F.substring(content, 1, 4))
    declared = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"), DECLARED, 1))
    found = F.when(F.lit(False), F.lit(""))
    for start, name in (MARKS | UNMARKED).items():
        found = found.when(first.startswith(start), F.lit(name))
    return F.when(content.isNotNull(), found.otherwise(F.when(declared == "", F.lit("utf-8")).otherwise(declared)))


def _without_mark(content: Column) -> Column:
    first = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), content)
    for mark in MARKS:
        n = len(mark) // 2
        out = out.when(first.startswith(mark), F.substring(content, F.lit(n + 1), F.octet_length(content) - n))
    return out.otherwise(content)


def decode_xml(content: Column) -> Column:
    """``struct<text, problem>`` of the bytes of an XML record; one of both is null.

    A byte-order mark goes before the declaration and is not part of the text. UTF-8, ISO-8859-1 and ASCII are decoded by
    Spark, other encodings by Python's codecs, to which no other record's bytes are sent. Bytes that the encoding
    does not have, unknown encodings and a null content are problems, never errors.
    """
    ship_code(SparkSession.active())

    @F.arrow_udf("struct<text string, problem string>")
    def by_codec(contents: pa.Array, names: pa.Array) -> pa.Array:
        rows = []
        for data, name in zip(contents.to_pylist(), names.to_pylist(), strict=True):
            if data is None:
                rows.append(None)
                continue
            try:
                text = data.decode(name)
                # A lone half of a pair is no character; neither Spark nor Arrow can hold it.
                text.encode()
                rows.append({"text": text, "problem": None})
            except LookupError:
                rows.append({"text": None, "problem": f"unknown encoding {name}"})
            except ValueError:
                rows.append({"text": None, "problem": f"not valid {name}"})
        return pa.array(rows, pa.struct([("text", pa.string()), ("problem", pa.string())]))

    name, body = xml_encoding(content), _without_mark(content)
    marked = F.hex(F.substring(content, 1, 4)).rlike("^(" + "|".join(MARKS | UNMARKED) + ")")
    single = F.decode(body, "ISO-8859-1")
    own = name.isin(*UTF8, *LATIN1, *ASCII)
    lie = ~marked & name.rlike(WIDE)
    other = by_codec(F.when(~own & ~lie, body), name)
    text = (
        F.when(name.isin(*UTF8), F.try_validate_utf8(body.cast("string")))
        .when(name.isin(*LATIN1), single)
        .when(name.isin(*ASCII), F.when(~single.rlike(r"[^\x00-\x7F]"), single))
        .when(~lie, other["text"])
    )
    problem = (
        F.when(content.isNull(), F.lit("no text"))
        .when(lie, F.concat(F.lit("declares "), name, F.lit(", but has one byte a character")))
        .when(own & text.isNull(), F.concat(F.lit("not valid "), name))
        .when(~own, other["problem"])
    )
    return F.struct(text.alias("text"), problem.alias("problem"))
