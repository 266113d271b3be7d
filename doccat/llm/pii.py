"""Personal data: patterns, and words that reveal what the patterns protect.

Protected entities have several grains: the value itself, the domain of an address, the first half of an ip, the first
digits of a card or phone number, and the kind. Every term of every text that holds a value is counted with all of them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from doccat.llm.common import Batches, arrow_map
from doccat.operators.scale import cut, fits_broadcast

# Kinds in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("general", "remove")
# Bits of evidence before a term can reveal an entity: different surroundings times the entity's information content.
EVIDENCE = 32.0
# A word is generalised when its pointwise mutual information with an entity is at least this part
# of the entity's information content, and removed when it is practically all of it.
DISCLOSES = 0.9
REVEALS = 0.999

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NO_DIGITS = re.compile("[^0-9]+")
_STEP = 64


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap; each ``@`` is looked at once, so time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:
            piece = text[max(done, start - _STEP) : start]
            kept = len(piece)
            while kept and (piece[kept - 1].isascii() and (piece[kept - 1].isalnum() or piece[kept - 1] in "._%+-")):
                kept -= 1
            start -= len(piece) - kept
            if kept:
                break
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then by the order of ``KINDS``."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 37:
                digits = _NO_DIGITS.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _apart(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, str]]:
    """``(word, start, surroundings)`` of the words that share no character with a span; one pass over both.

    The surroundings are the words before and after.
    """
    ordered = sorted((s, e) for _, s, e in spans)
    at, reach = 0, -1
    last, held = "", None
    for m in _WORD.finditer(text):
        start, end = m.span()
        while at < len(ordered) and ordered[at][0] < end:
            reach = max(reach, ordered[at][1])
            at += 1
        if held:
            yield held[0], held[1], f"{held[2]} {m[0]}"
        held = (m[0], start, last) if reach <= start else None
        last = m[0]
    if held:
        yield held[0], held[1], f"{held[2]} "


def _key(text: str) -> int:
    from xxhash import xxh64_intdigest

    found = xxh64_intdigest(text.encode("utf-8", "replace"))
    return found - (1 << 64) if found >> 63 else found


def entities(kind: str, value: str) -> list[str]:
    """A value at all grains, the finest first."""
    if kind == "email":
        plain = value.lower()
        part = plain.rpartition("@")[2]
    elif kind == "ip":
        plain = value
        part = ".".join(value.split(".")[:2])
    else:
        plain = _NO_DIGITS.sub("", value)
        part = plain[: 6 if kind == "card" else 5]
    return [f"{kind}:{plain}", f"{kind}/{part}", kind]


def term(word: Column) -> Column:
    """A word in lower case without what is no letter or digit at its ends."""
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def find(docs: DataFrame, keep: bool = False) -> DataFrame:
    """``_row, doc_id, _hash, _base, _values, _words``, one row per row of ``docs``; with ``keep`` also the text as
    ``_text`` and all other columns as the struct ``_doc``, so that no name can clash.

    ``_base`` are the pattern spans, ``_values`` the keys of their entities at all grains. ``_words`` has every word of a
    text with a value, its start and a key of its surroundings; words that share a character with a span are left out.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Batches) -> Batches:
        for batch in batches:
            bases, values, sizes = [], [], [0]
            words, starts, around = [], array("q"), array("q")
            for text in batch.column("_text").to_pylist():
                spans = base_spans(text or "")
                bases.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans])
                values.append(sorted({_key(x) for kind, s, e in spans for x in entities(kind, text[s:e])}))
                for word, start, near in _apart(text, spans) if spans else ():
                    words.append(word)
                    starts.append(start)
                    around.append(_key(near))
                sizes.append(len(words))
            listed = pa.StructArray.from_arrays(
                [pa.array(words, pa.string()), pa.array(np.array(starts, np.int64)), pa.array(np.array(around, np.int64))],
                ["word", "start", "around"],
            )
            names = [n for n in batch.schema.names if n != "_text" or keep]
            columns = [batch.column(n) for n in names] + [
                pa.array(bases, pa.list_(span)), pa.array(values, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), listed),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_base", "_values", "_words"])

    text = F.col("text").cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    picked = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("_hash"), *([F.struct(*others).alias("_doc")] if keep else []), text.alias("_text"),
    )
    schema = StructType([f for f in picked.schema if f.name != "_text" or keep])
    schema = schema.add("_base", ArrayType(_fields(kind="string", start="long", end="long")))
    schema = schema.add("_values", ArrayType(LongType()))
    schema = schema.add("_words", ArrayType(_fields(word="string", start="long", around="long")))
    return arrow_map(picked, scan, schema)


def _fields(**kinds: str) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its measured bytes fit."""
    return F.broadcast(table) if fits_broadcast(table) else table


def disclosing(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``value, term, kind`` (terms that reveal an entity; ``general`` or ``remove``), and where these can stand:
    ``_row, value, term, start, end``.

    Over all ``N`` documents, with ``n(c)`` documents of entity ``c``, ``n(t)`` of term ``t`` and ``n(c,t)`` of both, at any
    place of the text: ``PMI = log2(N n(c,t) / (n(c) n(t)))`` against ``IC = log2(N / n(c))``. Evidence is ``IC`` times the
    number of surroundings in different texts, divided by how many of them are the same: copies, near copies and fixed
    phrases prove little.

    Two bounds keep the counted pairs few and lose none. An entity needs texts enough for the evidence. A term that reveals
    one is in it with ``n(c,t) / n(t) >= 2 ** (-(1 - DISCLOSES) IC)``, and ``IC <= log2(N)``: a term that stands more often
    in texts without any entity is out before pairs are made.
    """
    total = found.count()
    n = F.lit(float(max(1, total)))
    # Entities and terms are made distinct in their row, and one row stands for each text: plain sums count both.
    having = found.filter(F.size("_values") > 0)
    firsts = cut(having.groupBy("_hash").agg(F.min("_row").alias("_row")).select("_row", F.lit(1).alias("first")))
    listed = having.select("_row", F.explode("_values").alias("value")).join(_small(firsts), "_row", "left").fillna(0, "first")
    content = F.log2(n / F.col("n_value"))
    values = cut(
        listed.groupBy("value").agg(F.count("*").alias("n_value"), F.sum("first").alias("texts"))
        .filter(F.col("texts") * content >= EVIDENCE).select("value", "n_value")
    )
    held = cut(listed.join(_small(values), "value", "left_semi"))
    words = having.select("_row", F.explode("_words").alias("x")).select(
        "_row", term(F.col("x.word")).alias("term"), F.col("x.start").alias("start"),
        (F.col("x.start") + F.length("x.word")).alias("end"), F.col("x.around").alias("around"),
    ).filter("term <> ''")
    rows = _small(cut(held.select("_row", "first").distinct()))
    own = F.array_distinct(F.transform("_words.word", lambda w: term(w)))
    terms = cut(
        having.select("_row", F.explode(own).alias("term")).filter("term <> ''").join(rows, "_row").groupBy("term")
        .agg(F.count("*").alias("n_any"), F.sum("first").alias("texts"))
        .filter(F.col("texts") * F.log2(n) >= EVIDENCE).select("term", "n_any")
    )
    every = docs.select(F.explode(F.array_distinct(F.transform(
        F.array_distinct(F.split(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+")), lambda w: term(w)
    ))).alias("term"))
    counts = every.join(_small(terms.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    least = F.pow(n, F.lit(DISCLOSES - 1.0))
    rare = cut(terms.join(counts, "term").filter(F.col("n_any") >= F.col("n_term") * least * (1 - 1e-9)).drop("n_any"))
    places = cut(
        words.join(_small(rare.select("term")), "term", "left_semi").join(held, "_row")
        .select("_row", "first", "value", "term", "start", "end", "around")
    )
    alike = places.filter("first = 1").groupBy("value", "term", "around").agg(F.count_distinct("_row").alias("same"))
    spread = alike.groupBy("value", "term").agg((F.sum("same") / F.max("same")).alias("spread"))
    both = places.groupBy("value", "term").agg(F.count_distinct("_row").alias("n_both"))
    mutual = F.log2(n * F.col("n_both") / (F.col("n_value") * F.greatest("n_term", "n_both")))
    rated = (
        both.join(spread, ["value", "term"]).join(_small(values), "value").join(_small(rare), "term")
        .filter((F.col("spread") * content >= EVIDENCE) & (mutual >= DISCLOSES * content))
    )
    kind = F.when(mutual >= REVEALS * content, "remove").otherwise("general")
    return cut(rated.select("value", "term", kind.alias("kind"))), places


def with_spans(docs: DataFrame, keep: bool = False) -> DataFrame:
    """``doc_id, _base`` and ``_spans`` (all spans in order), and what :func:`find` keeps."""
    found = cut(find(docs, keep))
    reveal, places = disclosing(docs, found)
    # "remove" is after "general" in the alphabet: the stronger one stands.
    added = places.join(_small(reveal), ["value", "term"]).groupBy("_row", "start", "end").agg(F.max("kind").alias("kind"))
    lists = added.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_added"))
    all_ = found.drop("_words", "_values").join(lists, "_row", "left")
    order = F.array(*map(F.lit, (*KINDS, *ADDED)))
    spans = F.concat("_base", F.coalesce("_added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    sorted_ = F.sort_array(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).alias("place"), x["kind"].alias("kind"), x["end"].alias("end")
    )))
    return all_.withColumn("_spans", sorted_).drop("_added", "_hash")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, one row per row of ``docs``.

    The whole text is searched; a null text is empty. Pattern spans always stay. In a text with a value, spans of the terms
    that reveal one of its entities (:func:`disclosing`) are added at every place and never overlap them. Repeated rows are
    rows like others, a null ``doc_id`` stays null, an empty table gives no rows. Other columns are not read.
    """
    each = with_spans(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return each.select("doc_id", *counts, F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with values and revealing words taken out of ``text``; all other columns as they are.

    A value becomes its kind in brackets, a word to generalise ``[WORD]``; a word to remove goes.
    Where spans overlap, the first one stands for all. ``n_chars``, if there, is counted anew. A null text stays null.
    """
    each = with_spans(docs, keep=True)

    def rewrite(batches: Batches) -> Batches:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                if spans:
                    parts, at = [], 0
                    for x in spans:
                        if x["start"] >= at:
                            mark = {"general": "[WORD]", "remove": ""}.get(x["kind"], f"[{x['kind'].upper()}]")
                            parts += [text[at : x["start"]], mark]
                        at = max(at, x["end"])
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(texts, pa.string())], ["_doc", "_text"])

    sent = each.select("_doc", "_text", "_spans")
    out = arrow_map(sent, rewrite, StructType([sent.schema["_doc"], sent.schema["_text"]]))
    if "n_chars" in docs.columns:
        count = F.length("_text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("_doc", F.col("_doc").withField("n_chars", count))
    return out.select(*[
        F.col("_text").alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns
    ])
