"""Write minimal xlsx files for the reader's tests."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letter(i):
    return chr(65 + i)


def write_workbook(path, rows, *, shared=True, sheet="xl/worksheets/data.xml"):
    """Rows of cells by position; None leaves a cell out, an all-None row is not stored.

    Texts go to the shared strings or inline, ints are numbers.
    """
    strings, xml = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, value in enumerate(row):
            ref = f"{_letter(i)}{n}"
            if value is None:
                continue
            if isinstance(value, int):
                cells.append(f'<c r="{ref}"><v>{value}</v></c>')
            elif shared:
                strings.append(value)
                cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                cells.append(
                    f'<c r="{ref}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
                )
        if cells:
            xml.append(f'<row r="{n}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>'
            '<sheet name="first" sheetId="4" r:id="rId9"/>'
            '<sheet name="second" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            "<Relationships>"
            '<Relationship Id="rId1" Target="worksheets/other.xml"/>'
            f'<Relationship Id="rId9" Target="{sheet.removeprefix("xl/")}"/></Relationships>',
        )
        book.writestr(
            sheet,
            f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(xml)}</sheetData></worksheet>',
        )
        if strings:
            items = "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r>"
                            "<rPh><t>hint</t></rPh></si>" for s in strings)
            book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{items}</sst>')
