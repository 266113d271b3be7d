"""Values of catalogue fields, and what is missing in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.functions import text as tx

# Single and multi-valued fields by name.
SINGLE = ("title", "class", "partner", "service", "abstract")
MULTI = {
    "themes": lambda: F.col("themes"),
    "attribute_labels": lambda: F.col("attributes.label"),
    "attribute_descriptions": lambda: F.col("attributes.description"),
}
# Folder name of each exported field.
EXPORT_NAMES = {
    "title": "TITRE",
    "class": "CLASSE",
    "partner": "PARTENAIRE",
    "service": "SERVICE",
    "themes": "THEMES",
    "abstract": "RESUME",
    "attribute_labels": "ATTRS_LABEL",
    "attribute_descriptions": "ATTRS_DESCR",
}


def get_fields(name: str) -> Column:
    """A multi-valued field as an array column."""
    if name not in MULTI:
        raise ValueError(f"unknown multi-valued field: {name}")
    return MULTI[name]()


def get_field(name: str) -> Column:
    """Any field by name."""
    if name in SINGLE:
        return F.col(name)
    if name not in MULTI:
        raise ValueError(f"unknown field: {name}")
    return get_fields(name)


def field_values(df: DataFrame, column: str | Column) -> DataFrame:
    """All values of a single-valued field, repeats kept."""
    return df.select((F.col(column) if isinstance(column, str) else column).alias("value"))


def list_values(df: DataFrame, column: str | Column) -> DataFrame:
    """All values of a multi-valued field, flattened."""
    return df.select(F.explode(column).alias("value"))


def distinct_values(values: DataFrame) -> DataFrame:
    """Distinct values; each task drops repeats before the shuffle."""
    return values.select("value").distinct()


def nonempty(values: DataFrame) -> DataFrame:
    return values.filter(F.col("value") != "")


def field_completeness(entities: DataFrame, short: int = 5) -> DataFrame:
    """One row: how many records lack each field, have a short abstract, or repeat the title."""
    words = F.size(F.split(F.rtrim("abstract"), " "))
    return entities.agg(
        F.count("*").alias("n_records"),
        *[F.count_if(F.col(c) == "").alias(f"empty_{c}") for c in SINGLE],
        F.count_if(F.size("themes") == 0).alias("empty_themes"),
        F.count_if(F.size("attributes") == 0).alias("empty_attributes"),
        F.count_if(words < short).alias("short_abstract"),
        F.count_if(F.col("title") == F.col("class")).alias("title_is_class"),
    )


def incomplete_records(entities: DataFrame, key: str = "id", short: int = 5) -> DataFrame:
    """``(key, problem)``: one row per missing field of a record, in one pass."""
    checks = [F.when(F.col(c) == "", F.lit(f"empty {c}")) for c in SINGLE]
    checks += [
        F.when(F.size("themes") == 0, F.lit("empty themes")),
        F.when(F.size("attributes") == 0, F.lit("empty attributes")),
        F.when(F.size(F.split(F.rtrim("abstract"), " ")) < short, F.lit("short abstract")),
        F.when(F.col("title") == F.col("class"), F.lit("title is class")),
    ]
    return entities.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def entity_card(entities: DataFrame, key: str = "id") -> DataFrame:
    """``(key, card)``: a readable dump of each record."""
    pairs = F.transform(
        "attributes",
        lambda a: F.concat(F.lit("label: "), a["label"], F.lit("\ndescription: "), a["description"]),
    )
    lines = F.concat(
        F.array(
            F.concat(F.lit("Id: "), F.col(key).cast("string")),
            F.concat(F.lit("Filename: "), F.col("path")),
            F.concat(F.lit("Titre: "), F.col("title")),
            F.concat(F.lit("Classe: "), F.col("class")),
            F.concat(F.lit("Partenaire: "), F.col("partner")),
            F.concat(F.lit("Service: "), F.col("service")),
            F.lit("Themes: "),
        ),
        F.col("themes"),
        F.array(F.concat(F.lit("Resume: "), F.col("abstract")), F.lit("Attributes: ")),
        pairs,
    )
    return entities.select(key, F.array_join(lines, "\n").alias("card"))


def field_documents(entities: DataFrame, key: str = "path") -> DataFrame:
    """``(field, doc_id, text)``: every exported text of every record, in one pass.

    Lists are joined by line. Besides the single fields there are the whole record, the
    readable class, and title with abstract.
    """
    column = F.col
    whole = tx.entity_text(
        column("title"), column("class"), column("partner"), column("service"),
        column("themes"), column("abstract"), column("attributes"),
    )
    texts = {
        "ALL": whole,
        "CLASSES": tx.class_label(column("class")),
        "TITRE_RESUME": tx.title_abstract(column("title"), column("abstract")),
    }
    for name in SINGLE:
        texts[EXPORT_NAMES[name]] = column(name)
    for name in MULTI:
        texts[EXPORT_NAMES[name]] = F.array_join(get_fields(name), "\n")
    rows = F.array(
        *[F.struct(F.lit(n).alias("field"), t.alias("text")) for n, t in texts.items()]
    )
    exploded = entities.select(F.col(key).alias("doc_id"), F.explode(rows).alias("r"))
    return exploded.select("r.field", tx.text_name(column("doc_id").cast("string")).alias("doc_id"), "r.text")


def field_lists(entities: DataFrame) -> DataFrame:
    """``(field, value)``: all values of all fields, repeats kept, in one pass."""
    def tagged(name: str) -> Column:
        items = F.array(F.col(name)) if name in SINGLE else get_fields(name)
        label = F.lit(EXPORT_NAMES[name]).alias("field")
        return F.transform(items, lambda v: F.struct(label, v.alias("value")))

    values = [tagged(name) for name in EXPORT_NAMES]
    return entities.select(F.explode(F.concat(*values)).alias("r")).select("r.field", "r.value")


def unique_values(entities: DataFrame) -> DataFrame:
    """``(field, key, value)``: distinct values of the fields that get a file per value.

    Empty titles, partners and services are left out; ``key`` is safe as a file name.
    """
    filtered = [EXPORT_NAMES[n] for n in ("title", "partner", "service")]
    whole = [EXPORT_NAMES[n] for n in ("themes", "attribute_labels")]
    listed = field_lists(entities).filter(
        F.col("field").isin(whole) | (F.col("field").isin(filtered) & (F.col("value") != ""))
    )
    return listed.distinct().select("field", tx.safe_key(F.col("value")).alias("key"), "value")
