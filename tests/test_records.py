import pytest
from pyspark.sql import functions as F

from doccat.functions import xml as xf
from doccat.operators import fields as fl
from doccat.plans.jobs import job_extract
from doccat.sources import records as rc

RECORD = """<metadata><title>SIT.A.ROUTES_X</title><dataIdInfo><idCitation><resTitle>Routes</resTitle></idCitation>
<rpXTPartName>P1</rpXTPartName><x><rpXTPartName>P2</rpXTPartName></x>
<idAbs>a<b>b1</b> c &amp; d</idAbs><idAbs>Z</idAbs>
<tpCat><descXT>eau</descXT></tpCat><tpCat><descXT/></tpCat><tpCat><descXT lang="fr">sol <i>vert</i></descXT></tpCat>
</dataIdInfo><eainfo><detailed><attr><attrlabl>id</attrlabl></attr>
<attr><attrlabl>nom</attrlabl><atXTdesc>dd</atXTdesc></attr><attr/></detailed></eainfo></metadata>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("records")
    (root / "sub").mkdir()
    (root / "a.xml").write_text(RECORD, encoding="utf-8")
    (root / "sub" / "a.xml").write_text("<metadata><title>T</title></metadata>", encoding="utf-8")
    (root / "sub" / "broken.xml").write_text("<a><b></a>", encoding="utf-8")
    (root / "other.XML").write_text("<a/>", encoding="utf-8")
    return str(root)


def test_records_are_found_in_all_folders(spark, folder):
    records = rc.read_xml_records(spark, folder)
    assert sorted(r["name"] for r in records.collect()) == ["a.xml", "a.xml", "broken.xml"]
    assert rc.count_records(records).first()["n_records"] == 3
    (bad,) = rc.rejected_records(records).collect()
    assert bad["path"].endswith("/sub/broken.xml") and "mismatched tag" in bad["reason"]


def test_entities(spark, folder):
    entities = rc.build_entities(rc.read_xml_records(spark, folder)).orderBy("id").collect()
    first, second = entities
    assert (first["id"], second["id"]) == (1, 2)
    assert first["title"] == "Routes" and first["class"] == "SIT.A.ROUTES_X"
    assert first["partner"] == "P1P2" and first["service"] == ""
    assert first["abstract"] == "ab1 c & dZ"
    assert first["themes"] == ["eau", "", "sol vert"]
    assert [tuple(a) for a in first["attributes"]] == [("ID", ""), ("NOM", "dd"), ("", "")]
    assert second["class"] == "T" and second["themes"] == [] and second["attributes"] == []


def test_fields(spark, folder):
    entities = rc.build_entities(rc.read_xml_records(spark, folder))
    assert entities.orderBy("id").select(fl.get_field("title")).first()[0] == "Routes"
    with pytest.raises(ValueError):
        fl.get_field("colour")
    with pytest.raises(ValueError):
        fl.get_fields("title")
    report = fl.field_completeness(entities).first().asDict()
    assert report["n_records"] == 2 and report["empty_title"] == 1 and report["empty_themes"] == 1
    problems = {(r["id"], r["problem"]) for r in fl.incomplete_records(entities).collect()}
    assert (2, "empty title") in problems and (1, "empty title") not in problems
    assert "label: NOM\ndescription: dd" in fl.entity_card(entities).orderBy("id").first()["card"]


def test_extract_job_replaces_earlier_output(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        job_extract(spark, folder, out)
    assert spark.read.parquet(f"{out}/entities").count() == 2
    assert tuple(spark.read.parquet(f"{out}/counts").first()) == (3, 2, 1)
    assert spark.read.parquet(f"{out}/rejects").first()["path"].endswith("/sub/broken.xml")
    docs = spark.read.parquet(f"{out}/documents")
    assert docs.select("field").distinct().count() == 11
    whole = docs.filter("field = 'ALL' AND doc_id NOT LIKE '%sub%'").first()["text"]
    assert whole.split("\n") == [
        "Routes", "SIT.A.ROUTES_X", "P1P2", "", "eau", "", "sol vert", "ab1 c & dZ", "ID: ", "NOM: dd", ": ",
    ]
    labels = spark.read.text(f"{out}/lists/ALL").filter("field = 'ATTRS_LABEL'")
    assert sorted(r["value"] for r in labels.collect()) == ["", "ID", "NOM"]
    keys = spark.read.parquet(f"{out}/unique").filter("field = 'PARTENAIRE'").collect()
    assert [r["value"] for r in keys] == ["P1P2"]


def test_text_corpus(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "d.txt").write_text("un\ndeux\n", encoding="utf-8")
    docs = rc.read_text_corpus(spark, str(tmp_path)).collect()
    assert len(docs) == 1 and docs[0]["text"] == "un\ndeux\n" and docs[0]["doc_id"].endswith("/x/d.txt")


def test_malformed_xml_is_seen(spark):
    df = spark.createDataFrame([("<a/>",), ("<a",), (None,), ("",)], "x string")
    seen = [r[0] for r in df.select(xf.is_well_formed(F.col("x"))).collect()]
    assert seen[:3] == [True, False, False] and not seen[3]


@pytest.mark.parametrize(
    "body, themes",
    [
        ('<descXT a="1>0">a</descXT>', ["a"]),
        ("<x:descXT xmlns:x='u'>a</x:descXT><x:descXT>b</x:descXT>", ["a", "b"]),
        ("<descXT><![CDATA[<a> & b]]></descXT>", ["<a> & b"]),
        ("<descXT>a\ue000b\ue001</descXT><descXT/>", ["a\ue000b\ue001", ""]),
        ("<descXT>a<descXT>b</descXT>c</descXT>", ["abc", "b"]),
        ("<!-- <descXT>no</descXT> --><descXT>&#233;&lt;</descXT>", ["é<"]),
    ],
)
def test_lists_follow_the_structure(spark, body, themes):
    xml = f"<m><dataIdInfo><tpCat>{body}</tpCat></dataIdInfo><descXT>outside</descXT></m>"
    df = spark.createDataFrame([("p", xml)], "path string, xml string")
    assert df.select(xf.xml_list(F.col("xml"), xf.THEME_PATH)).first()[0] == themes
    assert rc.extract_fields(df).first()["themes"] == themes


def test_prefixes_do_not_hide_attributes(spark):
    xml = """<g:m xmlns:g="u"><g:title>T</g:title><g:eainfo><g:attr><g:attrlabl>n</g:attrlabl></g:attr></g:eainfo></g:m>"""
    df = spark.createDataFrame([("p", xml), ("q", "<a"), ("r", None)], "path string, xml string")
    rows = {r["path"]: r for r in rc.parse_records(df).collect()}
    assert rows["p"]["class"] == "T" and [tuple(a) for a in rows["p"]["attributes"]] == [("N", "")]
    assert rows["q"]["reason"] and rows["r"]["reason"] == "no text" and rows["r"]["themes"] is None


BODY = "<m><title>T é</title><dataIdInfo><idAbs>à la carte</idAbs></dataIdInfo></m>"
ENCODED = {
    "utf8": BODY.encode(),
    "mark": b"\xef\xbb\xbf" + f"<?xml version='1.0' encoding='utf-8'?>{BODY}".encode(),
    "latin": f'<?xml version="1.0" encoding="ISO-8859-1"?>{BODY}'.encode("latin-1"),
    "latin9": f"<?xml version='1.0'  encoding = 'ISO-8859-15' standalone='yes' ?>{BODY}".encode("iso-8859-15"),
    "windows": f"<?xml version='1.0' encoding='windows-1252'?>{BODY}".encode("cp1252"),
    "big": "﻿".encode("utf-16-be") + f"<?xml version='1.0' encoding='UTF-16'?>{BODY}".encode("utf-16-be"),
    "little": "﻿".encode("utf-16-le") + f"<?xml version='1.0' encoding='UTF-16'?>{BODY}".encode("utf-16-le"),
    "unmarked": f"<?xml version='1.0' encoding='UTF-16'?>{BODY}".encode("utf-16-le"),
    "four": "﻿".encode("utf-32-be") + BODY.encode("utf-32-be"),
}
BROKEN = {
    "cut": (b"<m><title>\xc3</title></m>", "not valid utf-8"),
    "undeclared": (BODY.encode("latin-1"), "not valid utf-8"),
    "ascii": (f"<?xml version='1.0' encoding='US-ASCII'?>{BODY}".encode(), "not valid us-ascii"),
    "odd": ("﻿".encode("utf-16-le") + BODY.encode("utf-16-le") + b"x", "not valid utf-16le"),
    "half": ("﻿".encode("utf-16-le") + b"\x00\xd8<\x00", "not valid utf-16le"),
    "strange": (f"<?xml version='1.0' encoding='klingon'?>{BODY}".encode(), "unknown encoding klingon"),
    "binary": (f"<?xml version='1.0' encoding='hex'?>{BODY}".encode(), "unknown encoding hex"),
    "lie": (f"<?xml version='1.0' encoding='UTF-16'?>{BODY}".encode(), "declares utf-16, but has one byte a character"),
    "blank": (b" ", "no element found"),
    "malformed": (b"<m><title>", "no element found"),
}


def test_encodings(spark, tmp_path):
    for name, data in ENCODED.items():
        (tmp_path / f"{name}.xml").write_bytes(data)
    for name, (data, _) in BROKEN.items():
        (tmp_path / f"{name}.xml").write_bytes(data)
    records = rc.read_xml_records(spark, str(tmp_path))
    assert records.columns == ["path", "name", "xml", "problem"]
    rows = {r["path"].rsplit("/", 1)[1][:-4]: r for r in rc.parse_records(records).collect()}
    assert rows.keys() == ENCODED.keys() | BROKEN.keys()
    for name in ENCODED:
        assert rows[name]["reason"] is None, (name, rows[name]["reason"])
        assert (rows[name]["class"], rows[name]["abstract"]) == ("T é", "à la carte"), name
    for name, (_, why) in BROKEN.items():
        assert rows[name]["reason"].startswith(why) and rows[name]["class"] is None, (name, rows[name]["reason"])
    assert {r["path"].rsplit("/", 1)[1][:-4] for r in rc.rejected_records(records).collect()} == BROKEN.keys()
    # The texts parse the same way when Spark reads them.
    good = records.filter("problem IS NULL AND name = 'latin.xml'")
    assert good.select(xf.xml_text(F.col("xml"), "//title")).first()[0] == "T é"


def test_extract_job_survives_wrong_bytes(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "good.xml").write_bytes(ENCODED["latin"])
    (folder / "bad.xml").write_bytes(b"<m><title>\xe9</title></m>")
    job_extract(spark, str(folder), out)
    assert tuple(spark.read.parquet(f"{out}/counts").first()) == (2, 1, 1)
    assert spark.read.parquet(f"{out}/rejects").first()["reason"] == "not valid utf-8"
    assert spark.read.parquet(f"{out}/entities").first()["class"] == "T é"


def test_texts_and_made_records_with_wrong_bytes(spark, tmp_path):
    (tmp_path / "d.txt").write_bytes(b"a\xff\xc3\xa9")
    assert rc.read_text_corpus(spark, str(tmp_path)).first()["text"] == "a�é"
    df = spark.createDataFrame([("p", bytearray(b"<m>\xff</m>"))], "path string, b binary").selectExpr("path", "cast(b as string) AS xml")
    assert rc.parse_records(df).first()["reason"] == "not valid utf-8"
    assert df.select(xf.xml_list(F.col("xml"), "//m"), xf.xml_pairs(F.col("xml"))).first()[0] is None
