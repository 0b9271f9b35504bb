"""Sheets of the common form are read without a tree of elements; all others by the XML parser, with the same rows."""

import io
import zipfile

import pytest

from lakeward.sources import readers

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
HEAD = '<row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="str"><v>c</v></c></row>'


def book(body, head="", tail=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="i"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="i" Target="sheet.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>b</t></si><si><t>B &amp; é</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sheet.xml", f"{head}<worksheet {MAIN}><sheetData>{body}</sheetData>{tail}</worksheet>")
    return out.getvalue()


PLAIN = HEAD + '<row><c r="A2" t="inlineStr"><is><t xml:space="preserve"> x &lt;&#233;&gt; </t></is></c><c r="B2" t="s"><v>1</v></c><c r="C2" s="1"><v>46025</v></c></row><row><c/><c/><c/></row><row><c r="C9"><v>1.5</v></c><c r="A9" t="inlineStr"/></row><row><c r="B3"><v></v></c><c r="A3" t="b"><v>1</v></c></row>'
ROWS = [{"a": " x <é> ", "b": "B & é", "c": "2026-01-03"}, {"a": "", "b": None, "c": "1.5"}, {"a": "1", "b": None, "c": None}]


@pytest.mark.parametrize(("body", "plain"), [(PLAIN, True), (PLAIN.replace("<v>1.5</v>", "<f>1+0.5</f><v>1.5</v>"), False), (PLAIN.replace("<v>1.5</v>", "<v><![CDATA[1.5]]></v>"), False), (PLAIN.replace(' r="A2" t="inlineStr"', ' t="inlineStr" r="A2"'), False), (PLAIN.replace("<row><c/>", "<!-- <row><c><v>9</v></c></row> --><row><c/>"), False), (PLAIN.replace("</row><row>", "</row>\n<row>"), False)])
def test_both_readings_agree(body, plain, monkeypatch):
    seen = []
    whole = readers._parsed_cells
    monkeypatch.setattr(readers, "_parsed_cells", lambda xml: seen.append(1) or whole(xml))
    assert readers.sheet_rows(book(body), "s") == ROWS
    assert bool(seen) is not plain
    monkeypatch.setattr(readers, "_plain_cells", lambda xml: None)
    assert readers.sheet_rows(book(body), "s") == ROWS


def test_a_broken_sheet_is_an_error():
    for content in (book(PLAIN, tail="<a>"), book(PLAIN + "<row><c>"), book(PLAIN.replace("&lt;", "&"))):
        with pytest.raises(Exception, match="mismatched|not well-formed|invalid"):
            readers.sheet_rows(content, "s")


def test_tasks_write_whole_workbooks(spark, tmp_path, monkeypatch):
    """Every row is in one workbook, none has more than the limit, and nothing else is left in the folder."""
    from lakeward.plans import filebed

    monkeypatch.setattr(filebed, "SHEET_ROWS", 3)
    rows = [(f"k{k}", x) for k, x in enumerate(["a", None, "", " b ", "<c> & 'd' \"e\"", "é ]]> x", "two\n lines"])]
    filebed._workbooks(spark, spark.createDataFrame(rows, "k string, v string").repartition(2), str(tmp_path / "out"), "claims")
    found = [readers.sheet_rows(p.read_bytes(), "claims") for p in sorted((tmp_path / "out").glob("claims_*.xlsx"))]
    assert {p.suffix for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {".xlsx"} and max(map(len, found)) <= 3
    assert sorted((r["k"], r["v"]) for part in found for r in part) == sorted((k, v or None) for k, v in rows)


CELL = '<c t="inlineStr"><is><t>{}</t></is></c>'
TEXTS = "<row>" + "".join(CELL.format(x) for x in "ab") + "</row><row>" + CELL.format("x &amp; &lt;y&gt;").replace("<t>", '<t xml:space="preserve">') + "<c/></row><row><c/><c/></row><row>" + CELL.format("") + CELL.format('q" xml:space="preserve">é') + "</row>"


@pytest.mark.parametrize(("body", "fast"), [(TEXTS, True), (TEXTS.replace("<row><c/><c/>", "<row><c/>"), False), (TEXTS.replace("é", "é\x7f\n"), False), (TEXTS.replace("<c/></row>", "<c><v>7</v></c></row>", 1), False), (TEXTS.replace(">b<", ">a<"), False), (TEXTS.replace("<row>", '<row r="1">'), False)])
def test_texts_alone_are_read_as_columns(body, fast):
    """A sheet of texts alone becomes columns without a dict for each row, any other goes by the rows; both give the same."""
    assert (readers._text_table(f"<worksheet><sheetData>{body}</sheetData></worksheet>".encode()) is not None) is fast
    rows = readers.sheet_rows(book(body), "s")
    assert readers.sheet_table(book(body), "s", ["b", "z", "a"]).to_pylist() == [{c: r.get(c) for c in "bza"} for r in rows]
