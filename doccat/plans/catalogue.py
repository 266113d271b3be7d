"""Queries over XML records and catalogue fields.

The XML text of a record is derived from a row of ``documents``; extraction has to give the
row back. Files, where a query needs them, are written one record each below the checkpoint
folder, from ``benchmark``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.functions import text as tx
from doccat.functions import xml as xf
from doccat.operators import fields as fl
from doccat.plans.jobs import job_extract
from doccat.plans.registry import new_folder, query, table
from doccat.sources import records as rc
from doccat.sources import sinks


def _escaped(column):
    out = F.replace(column, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _tag(name, body):
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def xml_records(spark, sf_dir) -> DataFrame:
    """``(path, xml)`` from documents: one record each, with repeated, empty and missing parts."""
    attributes = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.lit("<attr>"),
            _tag(xf.ATTRIBUTE_LABEL, F.concat(F.lit("line"), i.cast("string"))),
            F.when(F.length(line) % 3 == 0, F.lit("")).otherwise(
                _tag(xf.ATTRIBUTE_DESCRIPTION, _escaped(line))
            ),
            F.lit("</attr>"),
        ),
    )
    themes = F.when(F.col("lang") == "es", F.lit("")).otherwise(
        F.concat(
            _tag("tpCat", _tag("descXT", F.col("lang"))),
            F.lit("<tpCat><descXT/></tpCat>"),
            _tag("tpCat", F.concat(F.lit("<descXT>"), _tag("b", F.col("source")), F.lit(".</descXT>"))),
        )
    )
    service = F.when(F.col("lang") == "en", F.lit("")).otherwise(
        _tag("rpOrgName", F.concat(F.lit("org "), F.col("source")))
    )
    info = F.concat(
        _tag("idCitation", _tag("resTitle", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))),
        _tag("rpXTPartName", F.col("lang")),
        _tag("idPoC", _tag("rpXTPartName", F.col("source"))),
        service,
        _tag("idAbs", _escaped(F.col("text"))),
        themes,
    )
    whole = F.concat(
        _tag("title", F.concat(F.lit("SIT.A."), F.col("source"), F.lit("_"), F.col("lang"))),
        _tag("dataIdInfo", info),
        _tag("eainfo", _tag("detailed", F.array_join(attributes, ""))),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:
        docs = docs.repartition(cores)
    return docs.select(
        F.format_string("/%s/%012d.xml", F.col("source"), F.col("doc_id")).alias("path"),
        _tag("metadata", whole).alias("xml"),
        "doc_id",
    )


def entities(spark, sf_dir) -> DataFrame:
    return rc.extract_fields(xml_records(spark, sf_dir))


# The same fields straight from the table.
ENTITY_SQL = """
WITH e AS (
  SELECT doc_id,
         '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.xml' AS path,
         'Document ' || doc_id AS title,
         'SIT.A.' || source || '_' || lang AS class,
         lang || source AS partner,
         CASE WHEN lang = 'en' THEN '' ELSE 'org ' || source END AS service,
         CASE WHEN lang = 'es' THEN CAST([] AS VARCHAR[]) ELSE [lang, '', source || '.'] END AS themes,
         text AS abstract,
         list_transform(string_split(text, chr(10)), lambda line, i: 'LINE' || (i - 1)) AS labels,
         list_transform(string_split(text, chr(10)),
                        lambda line: CASE WHEN length(line) % 3 = 0 THEN '' ELSE line END) AS descriptions
  FROM documents
)
"""


@query("count_records", "SELECT count(*) AS n_records FROM documents")
def count_records(spark, sf_dir):
    return rc.count_records(xml_records(spark, sf_dir))


@query("xml_text", ENTITY_SQL + "SELECT path, title, class, partner, service, abstract FROM e")
def xml_text(spark, sf_dir):
    fields = [xf.xml_text(F.col("xml"), p).alias(n) for n, p in xf.FIELD_PATHS.items()]
    return xml_records(spark, sf_dir).select("path", *fields)


@query(
    "xml_list",
    ENTITY_SQL + "SELECT path, generate_subscripts(themes, 1) AS pos, unnest(themes) AS theme FROM e",
)
def xml_list(spark, sf_dir):
    themes = xf.xml_list(F.col("xml"), xf.THEME_PATH)
    rows = xml_records(spark, sf_dir).select("path", F.posexplode(themes))
    return rows.select("path", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("theme"))


@query(
    "xml_attributes",
    ENTITY_SQL
    + """SELECT path, generate_subscripts(labels, 1) AS pos, unnest(labels) AS label,
         unnest(descriptions) AS description FROM e""",
)
def xml_attributes(spark, sf_dir):
    rows = xml_records(spark, sf_dir).select("path", F.posexplode(xf.xml_pairs(F.col("xml"))))
    return rows.select(
        "path", (F.col("pos") + 1).cast("long").alias("pos"), "col.label", "col.description"
    )


@query(
    "class_label",
    """SELECT p_partkey, replace(replace('SIT.A.' || p_brand || '_' || p_type || '_' || p_name, 'A.', ''),
              '_', ' ') AS label FROM part""",
)
def class_label(spark, sf_dir):
    name = F.concat(F.lit("SIT.A."), F.concat_ws("_", "p_brand", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.class_label(name).alias("label"))


@query(
    "build_entities",
    ENTITY_SQL
    + """SELECT row_number() OVER (ORDER BY path) AS id, path, title, class, partner, service,
         array_to_string(themes, '|') AS themes, abstract, array_to_string(labels, '|') AS labels,
         array_to_string(descriptions, '|') AS descriptions FROM e""",
)
def build_entities(spark, sf_dir):
    return rc.build_entities(xml_records(spark, sf_dir)).select(
        "id", "path", "title", "class", "partner", "service",
        F.array_join("themes", "|").alias("themes"), "abstract",
        F.array_join("attributes.label", "|").alias("labels"),
        F.array_join("attributes.description", "|").alias("descriptions"),
    )


@query("title_abstract", ENTITY_SQL + "SELECT path, title || chr(10) || abstract AS text FROM e")
def title_abstract(spark, sf_dir):
    text = tx.title_abstract(F.col("title"), F.col("abstract"))
    return entities(spark, sf_dir).select("path", text.alias("text"))


ENTITY_TEXT = """array_to_string(list_concat([title, class, partner, service], themes, [abstract],
  list_transform(labels, lambda l, i: l || ': ' || descriptions[i])), chr(10))"""


@query("entity_text", ENTITY_SQL + f"SELECT path, {ENTITY_TEXT} AS text FROM e")
def entity_text(spark, sf_dir):
    c = F.col
    text = tx.entity_text(
        c("title"), c("class"), c("partner"), c("service"), c("themes"), c("abstract"), c("attributes")
    )
    return entities(spark, sf_dir).select("path", text.alias("text"))


@query(
    "get_field",
    ENTITY_SQL
    + """SELECT path, title, class, partner, service, abstract,
         array_to_string(themes, '|') AS themes FROM e""",
)
def get_field(spark, sf_dir):
    single = [fl.get_field(n).alias(n) for n in fl.SINGLE]
    return entities(spark, sf_dir).select(
        "path", *single, F.array_join(fl.get_field("themes"), "|").alias("themes")
    )


@query(
    "get_fields",
    ENTITY_SQL
    + """SELECT path, array_to_string(themes, '|') AS themes, array_to_string(labels, '|') AS attribute_labels,
         array_to_string(descriptions, '|') AS attribute_descriptions FROM e""",
)
def get_fields(spark, sf_dir):
    lists = [F.array_join(fl.get_fields(n), "|").alias(n) for n in fl.MULTI]
    return entities(spark, sf_dir).select("path", *lists)


@query(
    "output_name",
    r"""SELECT page_id, regexp_replace(n, '\.xml$', '.txt') AS text_name,
        regexp_replace(regexp_replace(regexp_replace(n, '\.xml$', '.txt'), '^/', ''), '\.txt$', '.xml') AS record_name
        FROM (SELECT page_id, '/' || url || '.xml' AS n FROM pages)""",
)
def output_name(spark, sf_dir):
    name = F.concat(F.lit("/"), F.col("url"), F.lit(".xml"))
    text_name = tx.text_name(name)
    return table(spark, sf_dir, "pages").select(
        "page_id", text_name.alias("text_name"), tx.record_name(text_name).alias("record_name")
    )


@query("safe_key", "SELECT page_id, replace(url, '/', '') AS key FROM pages")
def safe_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_key(F.col("url")).alias("key"))


@query(
    "entity_card",
    ENTITY_SQL
    + """SELECT doc_id, array_to_string(list_concat(
           ['Id: ' || doc_id, 'Filename: ' || path, 'Titre: ' || title, 'Classe: ' || class,
            'Partenaire: ' || partner, 'Service: ' || service, 'Themes: '], themes,
           ['Resume: ' || abstract, 'Attributes: '],
           list_transform(labels, lambda l, i: 'label: ' || l || chr(10) || 'description: ' || descriptions[i])
         ), chr(10)) AS card FROM e""",
)
def entity_card(spark, sf_dir):
    numbered = entities(spark, sf_dir).withColumn(
        "doc_id", F.regexp_extract("path", r"([0-9]+)\.xml$", 1).cast("long")
    )
    return fl.entity_card(numbered, "doc_id")


@query(
    "field_completeness",
    ENTITY_SQL
    + """SELECT count(*) AS n_records,
         count(*) FILTER (title = '') AS empty_title, count(*) FILTER (class = '') AS empty_class,
         count(*) FILTER (partner = '') AS empty_partner, count(*) FILTER (service = '') AS empty_service,
         count(*) FILTER (abstract = '') AS empty_abstract,
         count(*) FILTER (len(themes) = 0) AS empty_themes,
         count(*) FILTER (len(labels) = 0) AS empty_attributes,
         count(*) FILTER (len(string_split(rtrim(abstract), ' ')) < 5) AS short_abstract,
         count(*) FILTER (title = class) AS title_is_class FROM e""",
)
def field_completeness(spark, sf_dir):
    return fl.field_completeness(entities(spark, sf_dir))


@query(
    "incomplete_records",
    ENTITY_SQL
    + """SELECT path, 'empty service' AS problem FROM e WHERE service = ''
         UNION ALL SELECT path, 'empty themes' FROM e WHERE len(themes) = 0
         UNION ALL SELECT path, 'short abstract' FROM e WHERE len(string_split(rtrim(abstract), ' ')) < 5""",
)
def incomplete_records(spark, sf_dir):
    return fl.incomplete_records(entities(spark, sf_dir), "path")


@query("field_values", "SELECT c_mktsegment AS value FROM customer")
def field_values(spark, sf_dir):
    return fl.field_values(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("field_distinct", "SELECT DISTINCT p_name AS value FROM part")
def field_distinct(spark, sf_dir):
    return fl.distinct_values(fl.field_values(table(spark, sf_dir, "part"), "p_name"))


@query("list_values", "SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def list_values(spark, sf_dir):
    return fl.list_values(table(spark, sf_dir, "documents"), F.split("text", "\n"))


@query("list_distinct", "SELECT DISTINCT unnest(string_split(text, chr(10))) AS value FROM documents")
def list_distinct(spark, sf_dir):
    return fl.distinct_values(list_values(spark, sf_dir))


@query("nonempty", ENTITY_SQL + "SELECT service AS value FROM e WHERE service <> ''")
def nonempty(spark, sf_dir):
    return fl.nonempty(fl.field_values(entities(spark, sf_dir), "service"))


FIELD_LISTS = """
  SELECT 'TITRE' AS field, title AS value FROM e UNION ALL SELECT 'CLASSE', class FROM e
  UNION ALL SELECT 'PARTENAIRE', partner FROM e UNION ALL SELECT 'SERVICE', service FROM e
  UNION ALL SELECT 'THEMES', unnest(themes) FROM e UNION ALL SELECT 'RESUME', abstract FROM e
  UNION ALL SELECT 'ATTRS_LABEL', unnest(labels) FROM e
  UNION ALL SELECT 'ATTRS_DESCR', unnest(descriptions) FROM e
"""


@query(
    "write_field_docs",
    ENTITY_SQL
    + f""", t AS (SELECT *, regexp_replace(path, '\\.xml$', '.txt') AS name FROM e)
    SELECT 'ALL' AS field, name AS doc_id, {ENTITY_TEXT} AS text FROM t
    UNION ALL SELECT 'TITRE', name, title FROM t UNION ALL SELECT 'CLASSE', name, class FROM t
    UNION ALL SELECT 'CLASSES', name, replace(replace(class, 'A.', ''), '_', ' ') FROM t
    UNION ALL SELECT 'PARTENAIRE', name, partner FROM t UNION ALL SELECT 'SERVICE', name, service FROM t
    UNION ALL SELECT 'THEMES', name, array_to_string(themes, chr(10)) FROM t
    UNION ALL SELECT 'RESUME', name, abstract FROM t
    UNION ALL SELECT 'ATTRS_LABEL', name, array_to_string(labels, chr(10)) FROM t
    UNION ALL SELECT 'ATTRS_DESCR', name, array_to_string(descriptions, chr(10)) FROM t
    UNION ALL SELECT 'TITRE_RESUME', name, title || chr(10) || abstract FROM t""",
)
def write_field_docs(spark, sf_dir):
    out = new_folder(spark)
    sinks.write_field_docs(entities(spark, sf_dir), out)
    return spark.read.parquet(out).select("field", "doc_id", "text")


@query(
    "write_field_lists",
    ENTITY_SQL
    + f""", v AS (SELECT * FROM ({FIELD_LISTS}))
    SELECT 'ALL' AS list, field, unnest(string_split(value, chr(10))) AS value FROM v
    UNION ALL SELECT 'ALL_UNIQUE', field, unnest(string_split(value, chr(10)))
    FROM (SELECT DISTINCT field, value FROM v)""",
)
def write_field_lists(spark, sf_dir):
    """The written lines, read back; a value of several lines takes several lines."""
    out = new_folder(spark)
    sinks.write_field_lists(entities(spark, sf_dir), out)
    whole, unique = (
        spark.read.text(f"{out}/{name}").select(F.lit(name).alias("list"), "field", "value")
        for name in ("ALL", "ALL_UNIQUE")
    )
    return whole.unionByName(unique)


@query(
    "write_unique_values",
    ENTITY_SQL
    + f"""SELECT DISTINCT field, replace(value, '/', '') AS key, value FROM ({FIELD_LISTS})
    WHERE field IN ('THEMES', 'ATTRS_LABEL') OR (field IN ('TITRE', 'PARTENAIRE', 'SERVICE') AND value <> '')""",
)
def write_unique_values(spark, sf_dir):
    out = new_folder(spark)
    sinks.write_unique_values(entities(spark, sf_dir), out)
    return spark.read.parquet(out).select("field", "key", "value")


@query("overwrite", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0")
def overwrite(spark, sf_dir):
    """A second write replaces the first one."""
    nations, out = table(spark, sf_dir, "nation"), new_folder(spark)
    sinks.write_table(nations.select("n_nationkey", "n_name"), out)
    sinks.write_table(nations.filter("n_regionkey <> 0").select("n_nationkey", "n_name"), out)
    return spark.read.parquet(out)



def _xml_files(spark, sf_dir) -> str:
    """``benchmark`` as a folder of XML files, one record each, by Spark's XML writer."""
    out = new_folder(spark)
    record = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("A.ITEM_"), F.col("item_id").cast("string")).alias("title"),
        F.struct(
            F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("resTitle"),
            F.col("text").alias("idAbs"),
            F.array(F.struct(F.lit("quiz").alias("descXT")), F.struct(F.lit("test").alias("descXT"))).alias("tpCat"),
        ).alias("dataIdInfo"),
    )
    writer = record.write.format("xml").option("rootTag", "catalogue").option("rowTag", "metadata")
    writer.option("maxRecordsPerFile", 1).save(out)
    return out


FILES_SQL = """SELECT 'A.ITEM_' || item_id AS class, 'Item ' || item_id AS title, text AS abstract,
               'quiz|test' AS themes FROM benchmark"""


@query("read_xml_records", FILES_SQL)
def read_xml_records(spark, sf_dir):
    files = rc.read_xml_records(spark, _xml_files(spark, sf_dir))
    return rc.extract_fields(files).select(
        "class", "title", "abstract", F.array_join("themes", "|").alias("themes")
    )


@query("job_extract", FILES_SQL)
def extract_job(spark, sf_dir):
    out = new_folder(spark)
    job_extract(spark, _xml_files(spark, sf_dir), out)
    return spark.read.parquet(f"{out}/entities").select(
        "class", "title", "abstract", F.array_join("themes", "|").alias("themes")
    )


@query("count_record_files", "SELECT count(*) AS n_records FROM benchmark")
def count_record_files(spark, sf_dir):
    return rc.count_records(rc.read_xml_records(spark, _xml_files(spark, sf_dir)))


# Every record of one language is cut short, so that it is no XML any more.
@query("rejected_records", "SELECT '/' || source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.xml' AS path,"
       " lang = 'de' AS rejected FROM documents")
def rejected_records(spark, sf_dir):
    xml = F.col("xml")
    german = F.contains(xml, F.lit("<descXT>de</descXT>"))
    records = xml_records(spark, sf_dir).withColumn(
        "xml", F.when(german, xml.substr(F.lit(1), F.length(xml) - 1)).otherwise(xml)
    )
    return rc.parse_records(records).select("path", F.col("reason").isNotNull().alias("rejected"))


def encoded_records(spark, sf_dir) -> DataFrame:
    """``(path, name, content)`` from documents, as bytes in the encoding of the language; some bytes are spoiled."""
    rows = xml_records(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    lang, wide = F.col("lang"), F.col("xml").rlike(r"[^\x00-\u00FF]")

    def declared(name):
        return F.concat(F.lit(f"<?xml version='1.0' encoding='{name}'?>"), F.col("xml"))

    utf8 = F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), F.encode(declared("UTF-8"), "UTF-8"))
    content = (
        F.when((lang == "fr") & ~wide, F.encode(declared("ISO-8859-1"), "ISO-8859-1"))
        .when(lang == "de", F.encode(declared("UTF-16"), "UTF-16"))
        .when(lang == "es", utf8)
        .otherwise(F.encode(F.col("xml"), "UTF-8"))
    )
    # Every seventh record has a byte that UTF-8 never has, or one byte too few for UTF-16.
    odd = F.when(lang == "de", F.substring(content, F.lit(1), F.octet_length(content) - 1)).otherwise(
        F.concat(content, F.lit(bytearray(b"\xff")))
    )
    content = F.when(F.col("doc_id") % 7 == 0, odd).otherwise(content)
    return rows.select("path", F.regexp_extract("path", "[^/]*$", 0).alias("name"), content.alias("content"), "doc_id")


@query(
    "decode_records",
    r"""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN NULL
         WHEN lang = 'de' THEN 'not valid utf-16be'
         WHEN lang = 'fr' AND NOT regexp_matches(text, '[^\x{00}-\x{FF}]') THEN NULL ELSE 'not valid utf-8' END AS problem,
       CASE WHEN doc_id % 7 <> 0 THEN text END AS abstract FROM documents""",
)
def decode_records(spark, sf_dir):
    """Problems of the bytes, and the text of the records that are whole."""
    records = rc.decode_records(encoded_records(spark, sf_dir))
    whole = rc.extract_fields(records).select("path", "abstract")
    return records.select("path", "doc_id", "problem").join(whole, "path", "left").select("doc_id", "problem", "abstract")


@query("job_extract_counts", "SELECT count(*) AS n_records, count(*) AS n_entities, 0::BIGINT AS n_rejects FROM benchmark")
def job_extract_counts(spark, sf_dir):
    out = new_folder(spark)
    job_extract(spark, _xml_files(spark, sf_dir), out)
    return spark.read.parquet(f"{out}/counts")


@query(
    "job_extract_lists",
    """SELECT 'TITRE' AS field, 'Item ' || item_id AS value FROM benchmark
       UNION ALL SELECT 'CLASSE', 'A.ITEM_' || item_id FROM benchmark
       UNION ALL SELECT 'THEMES', unnest(['quiz', 'test']) FROM benchmark""",
)
def job_extract_lists(spark, sf_dir):
    """The lists as lines; texts with line ends of their own are checked as tables elsewhere."""
    out = new_folder(spark)
    job_extract(spark, _xml_files(spark, sf_dir), out)
    lists = spark.read.text(f"{out}/lists/ALL")
    return lists.filter(F.col("field").isin("TITRE", "CLASSE", "THEMES")).select("field", "value")


@query("job_extract_documents", "SELECT 'RESUME' AS field, text FROM benchmark")
def job_extract_documents(spark, sf_dir):
    out = new_folder(spark)
    job_extract(spark, _xml_files(spark, sf_dir), out)
    return spark.read.parquet(f"{out}/documents").filter("field = 'RESUME'").select("field", "text")


@query(
    "job_extract_unique",
    """SELECT 'TITRE' AS field, 'Item ' || item_id AS value FROM benchmark
       UNION ALL SELECT 'THEMES', unnest(['quiz', 'test'])""",
)
def job_extract_unique(spark, sf_dir):
    out = new_folder(spark)
    job_extract(spark, _xml_files(spark, sf_dir), out)
    return spark.read.parquet(f"{out}/unique").select("field", "value")


@query("read_text_corpus", "SELECT rtrim(text, chr(10)) AS text FROM benchmark")
def read_text_corpus(spark, sf_dir):
    out = new_folder(spark)
    texts = table(spark, sf_dir, "benchmark").select("text")
    texts.write.option("maxRecordsPerFile", 1).text(out)
    return rc.read_text_corpus(spark, out).select(F.rtrim("text", F.lit("\n")).alias("text"))
