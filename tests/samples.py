"""Small documents of every format, made by code."""

from __future__ import annotations

import io
import json
import zipfile
from pathlib import Path

MARKDOWN = """Harbour Lease Digest
====================

Opening words without a heading of their own.

**Key Figures**

| Unit | Rate | Share | Start |
| --- | --- | --- | --- |
| North | $1,200 | 12% | 2024-01-31 |
| South | $900 | 8.5% | 2024-02-30 |

## Outlook ##
The exit yield is 6.25% as of spring.

### Risks


None yet.
"""

HTML = """<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>
<section data-page-number="1"><h1>Fleet Register</h1><p>Opening&nbsp;note – short.<br>Second line</p>
<table><tr><th>Vessel</th><th>Flag State</th><th>Tonnage</th></tr>
<tr><td colspan="3">Tankers</td></tr>
<tr><td rowspan="2">Aurora</td><td>NO</td><td>1200</td></tr><tr><td>PA</td><td>900</td></tr>
<tr><td>---</td><td>---</td><td>---</td></tr></table></section>
<section data-page-number="2"><h2>Notes</h2><ul><li>One<li>Two</ul><table><tr><td>Key</td><td>Value</td></tr><tr><td>a</td><td>1</td></tr></table></section>
</body></html>"""

CSV = "Vessel,Flag,Tonnage\nAurora,NO,1200\n,,\nBoreas,PA\n"

PDF = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >> endobj
3 0 obj << /Type /Page /Parent 2 0 R >> endobj
4 0 obj << /Type /Page /Parent 2 0 R >> endobj
5 0 obj << /Producer (Harbour \\(Press\\)) /Title <FEFF0041> >> endobj
trailer << /Root 1 0 R /Info 5 0 R >>
%%EOF
"""


def xlsx(sheets: dict[str, dict[str, str]]) -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{names}</sheets></workbook>")
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        for i, cells in enumerate(sheets.values(), 1):
            rows: dict[int, str] = {}
            for ref, v in cells.items():
                n = int("".join(c for c in ref if c.isdigit()))
                rows[n] = rows.get(n, "") + (f'<c r="{ref}"><v>{v}</v></c>' if v.replace(".", "").isdigit() else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            body = "".join(f'<row r="{n}">{c}</row>' for n, c in sorted(rows.items()))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


WORKBOOK = {
    "Assumptions": {"A1": "Tenant", "B1": "Area", "A2": "Acme", "B2": "120", "A3": "Bolt", "B3": "80.5"},
    "Watch 2024": {"B4": "Loan Number", "C4": "Property Name", "B5": "17", "C5": "Mill"},
}


def write_all(folder: Path) -> dict[str, Path]:
    made = {}
    for name, body in {"digest.md": MARKDOWN, "fleet.html": HTML, "fleet.csv": CSV, "plain.txt": "Capital rate near 5.5% today\nend\n", "report.pdf": PDF, "book.xlsx": xlsx(WORKBOOK), "bad.xlsx": b"not a zip"}.items():
        made[name] = folder / name
        made[name].write_bytes(body if isinstance(body, bytes) else body.encode())
    return made


def manifest(paths: list[str], **extra) -> str:
    return "".join(json.dumps({"version": "hash.v0", "path": str(p), "bytes_hash": "sha256:00", "owner": "x"} | extra) + "\n" for p in paths)
