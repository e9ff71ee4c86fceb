"""Definitions as artefacts: a module of Python that builds the same columns."""

from __future__ import annotations

import json
import re
from dataclasses import asdict
from pathlib import Path

from .. import __version__
from ..functions.blake3 import blake3_hex
from .definitions import DefinitionError, load_text, validate
from .refusals import Refusal

TEMPLATE = '''"""Template {id!r}; generated, don't edit. Source {hash}."""

import json

from docmatch.operators import engine
from docmatch.plans.definitions import Assertion, Definition, Extract

SOURCE_HASH = {hash!r}
TOOL_VERSION = {version!r}
_D = json.loads({data!r})
DEFINITION = Definition(**_D | {{"assertions": [Assertion(**a) for a in _D["assertions"]], "extract": [Extract(**e) for e in _D["extract"]]}})


def evaluate(documents, diagnose=False):
    """Adds the verdict to documents (kind, path, view, sheets, pdf, extension)."""
    return engine.evaluate(documents, [DEFINITION], diagnose)
'''


def source_hash(text: str) -> str:
    return "blake3:" + blake3_hex(text.encode())


def module_name(template_id: str) -> str:
    return "template_" + (re.sub("[^a-z0-9]+", "_", template_id.lower()).strip("_") or "unnamed")


def compile_text(text: str) -> str:
    """The module's source, the same for the same definition; refuses a wrong one."""
    try:
        d = load_text(text)
    except DefinitionError as e:
        line = re.search(r"line (\d+)", str(e))
        raise Refusal(e.code, str(e), {"error": str(e), "line": int(line[1]) if line else None}) from e
    wrong = validate(d)
    if wrong:
        raise Refusal("E_INVALID_YAML", wrong[0], {"errors": wrong})
    d.definition_hash = source_hash(text)
    return TEMPLATE.format(id=d.template_id, hash=d.definition_hash, version=__version__, data=json.dumps(asdict(d), sort_keys=True))


def compile_file(path: str, out: str | None = None) -> str:
    """Writes the module into the folder ``out``, or returns its source."""
    text = Path(path).read_text(encoding="utf-8")
    source = compile_text(text)
    if out is None:
        return source
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / f"{module_name(load_text(text).template_id)}.py"
    target.write_text(source, encoding="utf-8")
    return str(target)
