"""Functions and methods of source files paired with their documentation.

Method. Signatures are detected with regular expressions per language family;
bodies are delimited by an indentation stack (Python) or by a stack of opening
and closing braces, respectively end keywords, with strings and comments skipped;
a comment is attached when it ends at most ``distance`` lines above the definition (1: on
the line straight above; annotations may stand between), a Python docstring when it is the
first statement of the body; it goes before a comment. Qualified names come from the stack
of enclosing classes.

Each file is read alone, so the extraction is a narrow transformation. The pairing
with ``code_entities`` is an equi-join on the entity id; files enter it as extracted
rows (id, signature, doc), never as contents. Hot files or repeated rows are reduced
per key before the join. A listed docstring is the wording that counts; ``origin`` tells
whether the extraction found the documentation in the file.

Whether documentation is real is scored: words that say something of their own count 1,
those of the name and those without content (grammar, vague words, words about the
documentation or its state) nothing; one word is enough.

Defined cases: null or empty content gives no pair; a body that is never closed ends
with the file; nested definitions are listed with their own name; repeated rows give
one pair; extra columns are ignored; when an id is defined twice in a file the first
definition with documentation counts; a signature whose brackets never close ends with its
first line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# --- signatures -----------------------------------------------------------------------------
_PY_DEF = re.compile(r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+([A-Za-z_]\w*)")
_CLASS = re.compile(r"^\s*(?:(?:export|default|public|protected|private|abstract|static|final|sealed|data|pub)\s+)*(?:class|interface|enum|record|trait|impl|struct|object)\s+([A-Za-z_$][\w$]*)")
_CONTROL = r"(?!(?:if|for|while|switch|catch|return|else|do|try|new|throw|await|function|typeof|delete|in|of|case|with|using|lock|match|super|constructor\b(?!))\b)"
_BRACE_DEFS = [
    # function name(...), export default async function* name(...)
    re.compile(r"^\s*(?:(?:export|default|declare|async|public|private|protected|static)\s+)*function\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\("),
    # func name(...), func (r *T) name(...), fn name(...)
    re.compile(r"^\s*(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|extern(?:\s+\"[^\"]*\")?|override|public|private|internal|open|suspend|inline|fileprivate|static|mutating)\s+)*(?:func|fn|fun)\s+(?:\(\s*\w*\s*\*?\s*(?P<recv>\w+)[^)]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]|<[^>(]*>)?\s*\("),
    # const name = (...) => , name = async x =>
    re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^>(]*>)?\([^;]*$|[A-Za-z_$][\w$]*\s*=>)"),
    # [modifiers] Type name(...) ... {   (Java, C#, C++)
    re.compile(rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|virtual|override|async|internal|sealed|inline|constexpr|explicit)\s+)+(?:<[^>(]*>\s*)?(?:[\w$.<>\[\],?&*:]+(?:\s+|\s*[*&]\s*))*?{_CONTROL}([A-Za-z_$][\w$]*)\s*\("),
    re.compile(rf"^\s*(?:[A-Za-z_][\w$.<>\[\],?&*:]*\s+){{1,3}}[*&]?{_CONTROL}([A-Za-z_$~][\w$]*)\s*\([^;]*$"),
    # name(...) {   (methods of JavaScript and TypeScript)
    re.compile(rf"^\s*(?:(?:async|static|get|set|readonly|public|private|protected|override|\*)\s+)*{_CONTROL}([A-Za-z_$#][\w$]*)\s*(?:<[^>(]*>)?\s*\([^;]*$"),
]
_WORD_DEFS = re.compile(r"^\s*(?:def|function|sub|procedure)\s+(?:self\.)?([A-Za-z_][\w.:?!]*)")
_PYTHON, _ENDED = {"py", "pyi"}, {"rb", "lua", "jl"}


def _lines(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", text)


# --- Python: an indentation stack ----------------------------------------------------------
def _string_at(line: str) -> tuple[str, int] | None:
    m = re.match(r"\s*(?:[rRbBuUfF]{0,2})(\"\"\"|'''|\"|')", line)
    return (m[1], m.end()) if m else None


def _read_string(lines: list[str], at: int) -> tuple[str, int] | None:
    """Text and last line of the string literal that starts line ``at``."""
    opened = _string_at(lines[at])
    if not opened:
        return None
    quote, col = opened
    parts, k, rest = [], at, lines[at][col:]
    while True:
        esc = 0
        while (end := rest.find(quote, esc)) > 0 and rest[end - 1] == "\\":
            esc = end + 1
        if end >= 0:
            return "\n".join([*parts, rest[:end]]), k
        if len(quote) == 1 or k + 1 >= len(lines):
            return ("\n".join([*parts, rest]), k) if len(quote) == 3 else None
        parts.append(rest)
        k, rest = k + 1, lines[k + 1]


# a line that can't stand inside a signature's brackets: the signature was never closed
_NEXT_PY = re.compile(r"^[ \t]*(?:async[ \t]+def|def|class|return|import|from|if|for|while|try|with)\b")


def _signature_end(lines: list[str], at: int) -> tuple[str, int]:
    """A Python signature's text on one line and the line on which its brackets close before the colon."""
    depth, parts = 0, []
    for k in range(at, len(lines)):
        line, quote = lines[k], ""
        if k > at and _NEXT_PY.match(line):
            break
        for j, c in enumerate(line):
            if quote:
                quote = "" if c == quote and line[j - 1] != "\\" else quote
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "#":
                line = line[:j]
                break
            elif c == ":" and depth <= 0:
                parts.append(line[:j])
                return _tidy(" ".join(parts)), k
        parts.append(line)
    return _tidy(parts[0]), at


class _Openings:
    """Where the signatures of a text of blanked lines end: at the first opening brace or semicolon outside their brackets."""

    def __init__(self, code: list[str]):
        self.code, text = code, "\n".join(code)
        self.text = text
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        up, down = np.isin(chars, [ord("("), ord("[")]), np.isin(chars, [ord(")"), ord("]")])
        self.depth = np.concatenate([[0], np.cumsum(up.astype(np.int32) - down.astype(np.int32))])
        self.ends = np.flatnonzero((chars == ord("{")) | (chars == ord(";")))
        self.starts = np.concatenate([[0], np.cumsum([len(line) + 1 for line in code])])

    def after(self, k: int) -> tuple[str, int]:
        """The signature's text on one line, and the line on which it ends."""
        at = self.starts[k]
        lo, width = int(np.searchsorted(self.ends, at)), 64
        while lo < len(self.ends):
            some = self.ends[lo : lo + width]
            hit = np.flatnonzero(self.depth[some] <= self.depth[at])
            if len(hit):
                end = int(some[hit[0]])
                return _tidy(self.text[at:end]), int(np.searchsorted(self.starts, end, side="right")) - 1
            lo, width = lo + width, width * 2
        return _tidy(self.code[k]), k


def _tidy(signature: str) -> str:
    """On one line, as if it had been written on one."""
    return re.sub(r",?\s*\)", ")", re.sub(r"\(\s+", "(", re.sub(r"\s+", " ", signature))).strip()


def _python(lines: list[str], distance: int = 1) -> list[dict]:
    out: list[dict] = []
    stack: list[tuple[int, str, str, int]] = []  # indent, kind, qualified name, place in out
    k = 0

    def pop(indent: int, before: int) -> None:
        while stack and stack[-1][0] >= indent:
            place = stack.pop()[3]
            out[place]["line_end"] = before

    last = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip() or line.lstrip().startswith("#"):
            k += 1
            continue
        indent = len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip())
        pop(indent, last)
        m = _PY_DEF.match(line)
        if not m:
            # a statement; skip the lines of a triple-quoted text inside it
            s = re.search(r"(\"\"\"|''')", line)
            if s:
                q = s[1]
                rest, j = line[s.end() :], k
                while q not in rest and j + 1 < len(lines):
                    j += 1
                    rest = lines[j]
                k = j
            last = k + 1
            k += 1
            continue
        owner = next((s for s in reversed(stack)), None)
        kind = "class" if m[2] == "class" else "method" if owner and owner[1] == "class" else "function"
        qualified = f"{owner[2]}.{m[3]}" if owner and owner[1] == "class" else m[3]
        signature, end = _signature_end(lines, k)
        doc, j = None, end + 1
        while j < len(lines) and not lines[j].strip():
            j += 1
        if j < len(lines):
            inner = len(lines[j].expandtabs(8)) - len(lines[j].expandtabs(8).lstrip())
            got = _read_string(lines, j) if inner > indent else None
            if got:
                doc, j = got
                end = j
        if doc is None or not doc.strip():
            doc = _comment_above(lines, k, distance) or doc
        out.append({"name": qualified, "kind": kind, "signature": signature, "doc": doc, "line_start": k + 1, "line_end": None})
        stack.append((indent, "class" if kind == "class" else "def", qualified, len(out) - 1))
        last = end + 1
        k = end + 1
    pop(-1, last)
    return out


# --- brace and end-keyword languages --------------------------------------------------------
def _comment_above(lines: list[str], at: int, distance: int = 1) -> str | None:
    """The comment that ends at most ``distance`` lines above line ``at``; annotations may stand between."""
    k, blank = at - 1, 0
    while k >= 0 and (re.match(r"^\s*(?:@\w|#\[|\[[A-Z]\w*)", lines[k]) or not lines[k].strip() and (blank := blank + 1) < distance):
        k -= 1
    if k < 0:
        return None
    line = lines[k].strip()
    if line.endswith("*/"):
        lo = k
        while lo >= 0 and "/*" not in lines[lo]:
            lo -= 1
        if lo < 0 or not lines[lo].lstrip().startswith("/*"):
            return None
        return "\n".join(lines[lo : k + 1])
    lo = k
    mark = "#" if line.startswith("#") else "--" if line.startswith("--") else "//"
    while lo >= 0 and lines[lo].strip().startswith(mark):
        lo -= 1
    return "\n".join(lines[lo + 1 : k + 1]) if lo < k else None


def _blank_out(lines: list[str], strings: str) -> list[str]:
    """The lines with the insides of strings and comments blanked, of the same lengths."""
    out, block, quote = [], False, ""
    for line in lines:
        chars, j = list(line), 0
        if quote != "`":
            quote = ""
        while j < len(line):
            two = line[j : j + 2]
            if block:
                if two == "*/":
                    block = False
                    chars[j : j + 2] = "  "
                    j += 2
                    continue
                chars[j] = " "
            elif quote:
                if line[j] == "\\":
                    chars[j : j + 2] = " " * len(chars[j : j + 2])
                    j += 2
                    continue
                if line[j] == quote:
                    quote = ""
                else:
                    chars[j] = " "
            elif two == "//":
                chars[j:] = " " * (len(line) - j)
                break
            elif two == "/*":
                block = True
                chars[j : j + 2] = "  "
                j += 2
                continue
            elif line[j] in strings:
                quote = line[j]
            j += 1
        out.append("".join(chars))
    return out


def _braces(lines: list[str], ext: str, distance: int = 1) -> list[dict]:
    out: list[dict] = []
    code = _blank_out(lines, "\"'`" if ext not in ("rs",) else '"')
    openings = _Openings(code)
    stack: list[tuple[str, str, int]] = []  # kind, name, place in out; one entry per open brace
    pending: tuple[str, str, int] | None = None
    for k, line in enumerate(code):
        owner = next((s for s in reversed(stack) if s[0] in ("class", "def")), None)
        inside_def = owner is not None and owner[0] == "def"
        c = _CLASS.match(line)
        if c and not inside_def:
            name = c[1]
            signature, _ = openings.after(k)
            out.append({"name": name, "kind": "class", "signature": signature, "doc": _comment_above(lines, k, distance), "line_start": k + 1, "line_end": None})
            pending = ("class", name, len(out) - 1)
        elif not inside_def or re.match(r"^\s*(?:async\s+)?function\b|^\s*func\s+\w", line):
            for n, rx in enumerate(_BRACE_DEFS):
                if n == 5 and not (owner and owner[0] == "class") or n == 4 and ext in ("js", "jsx", "mjs", "ts", "tsx", "go", "rs"):
                    continue
                if not (m := rx.match(line)):
                    continue
                signature, end = openings.after(k)
                opened = "{" in code[end] or n == 2
                if n in (3, 4, 5) and not opened and ";" not in code[end]:
                    continue
                signature = " ".join(lines[k : end + 1])
                signature = _tidy(re.sub(r"\s*\{\s*[^{}]*\}?\s*$", "", signature))
                name = m.groups()[-1]
                recv = m.groupdict().get("recv")
                holder = recv or (owner[1] if owner and owner[0] == "class" else None)
                out.append(
                    {"name": f"{holder}.{name}" if holder else name, "kind": "method" if holder else "function", "signature": signature,
                     "doc": _comment_above(lines, k, distance), "line_start": k + 1, "line_end": k + 1 if not opened else None}
                )
                pending = ("def", name, len(out) - 1) if opened else None
                break
        for ch in line:
            if ch == "{":
                stack.append(pending or ("", "", -1))
                pending = None
            elif ch == "}" and stack:
                place = stack.pop()[2]
                if place >= 0:
                    out[place]["line_end"] = k + 1
    for _, _, place in stack:
        if place >= 0:
            out[place]["line_end"] = len(lines)
    return out


_OPENERS = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for|function|local\s+function)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def _ended(lines: list[str], distance: int = 1) -> list[dict]:
    """Languages whose bodies close with an ``end`` keyword."""
    out: list[dict] = []
    stack: list[tuple[str, str, int]] = []
    for k, line in enumerate(lines):
        bare = re.sub(r"(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')", "''", line)
        bare = re.sub(r"(?:#|--).*$", "", bare)
        if re.match(r"^\s*end\b", bare):
            if stack:
                place = stack.pop()[2]
                if place >= 0:
                    out[place]["line_end"] = k + 1
            continue
        owner = next((s for s in reversed(stack) if s[0] == "class"), None)
        if c := re.match(r"^\s*(?:class|module)\s+([A-Z]\w*)", bare):
            out.append({"name": c[1], "kind": "class", "signature": line.strip(), "doc": _comment_above(lines, k, distance), "line_start": k + 1, "line_end": None})
            stack.append(("class", c[1], len(out) - 1))
        elif m := _WORD_DEFS.match(bare.replace("local function", "function")):
            name = f"{owner[1]}.{m[1]}" if owner else m[1]
            out.append({"name": name, "kind": "method" if owner else "function", "signature": line.strip(), "doc": _comment_above(lines, k, distance), "line_start": k + 1, "line_end": None})
            if not re.search(r"\bend\s*$", bare):
                stack.append(("def", m[1], len(out) - 1))
        elif _OPENERS.search(bare) and not re.search(r"\bend\s*$", bare):
            stack.append(("", "", -1))
    for _, _, place in stack:
        if place >= 0:
            out[place]["line_end"] = len(lines)
    return out


def extract(text: str | None, path: str | None, distance: int = 1) -> list[dict]:
    """Definitions of one file: name, kind, signature, doc (raw or None), line_start, line_end."""
    if not text:
        return []
    ext = (path or "").rsplit(".", 1)[-1].lower()
    lines = _lines(text)
    if ext in _PYTHON:
        return _python(lines, distance)
    return _ended(lines, distance) if ext in _ENDED else _braces(lines, ext, distance)


# --- is a documentation real? ---------------------------------------------------------------
_TAGS = re.compile(r"^(?:[@\\:](?:param|arg|argument|return|returns|type|rtype|throws|exception|raises|tparam|property|yields|see|since|author|version|deprecated|override|todo|inheritdoc)\b.*|\{@\w+[^}]*\})$", re.I)
_SECTION = re.compile(r"^(?:args?|arguments?|params?|parameters?|returns?|raises?|throws|yields?|inputs?|outputs?|attributes|keyword args|see also|examples?|notes?)\s*:?\s*$", re.I)
_INLINE_SECTION = re.compile(r"^(?:args?|arguments?|params?|parameters?|returns?|inputs?|outputs?)\s*:\s*(?:[\w\[\]., ]*)$", re.I)
_ITEM = re.compile(r"^[*\-]?\s*[`*]?\*{0,2}[A-Za-z_]\w*[`*]?\s*(?:\([^)]*\))?\s*(?::|--?|–)\s*.*$")
_EMPTY = re.compile(
    r"^(?:todo|fixme|xxx|tbd|tba|n/?a|wip|hack|none|nothing|placeholder|stub|empty|undocumented|dummy|\.+|…+|-+|=+|_+|\*+|#+"
    r"|(?:todo|fixme|xxx|tbd|hack)\b\W.*|(?:todo|fixme|xxx)\s.*|待补充|待完善|暂无|无|略|同上|见上|(?:see|as) (?:above|below|base class|parent|superclass|super|interface|the (?:docs?|readme|wiki|code|source))\W*(?:.*)"
    r"|see (?:also )?\S+|refer to .*|same as (?:above|below).*|(?:the )?docs?|documentation|doc ?strings?|description|summary|comment|helper(?: function| method)?|utility(?: function| method)?"
    r"|(?:internal |private |auto-?generated |generated )?(?:function|method|class|helper|stub|code|constructor|getter|setter)(?: stub)?"
    r"|(?:method|function|class)(?: description| documentation)?(?: goes here)?|(?:add |write |insert |put )?(?:a )?(?:description|documentation|docstring|docs?|comment)(?: goes)?(?: here| later)?"
    r"|no (?:documentation|description|docs?|comment)(?: (?:available|yet|provided|given))?|not documented(?: yet)?|missing (?:documentation|docs?)|your (?:documentation|description|docs?).*|lorem ipsum.*"
    r"|@?\{?@?inheritdoc\}?|(?:override|overridden|inherited)(?: method)?|auto-?generated.*)$",
    re.I,
)
# words without content of their own: grammar, vague words, words about the documentation and its state
_FILLER = set(
    "the a an this that these those some any all each every no not only just also here there it its itself our your my their his her we you they i me one ones"
    " is are was be been being has have had do does did done doing will would can could should shall may might must to of for in on at by with from as into and or but if then than so such per via etc"
    " function functions method methods routine procedure helper util utility class object implementation implements implement performs perform executes execute execution called call calls named name runs run works work working"
    " thing things stuff misc miscellaneous various something anything somehow whatever other others foo bar baz blah"
    " todo fixme xxx tbd wip hack placeholder stub dummy temp temporary text doc docs documentation docstring description describe comment comments note notes documented undocumented"
    " now later soon yet still finished unfinished incomplete implemented unimplemented needed needs missing added add write written fill filled better properly".split()
)


def _words(text: str) -> list[str]:
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    return re.findall(r"[^\W_]+", text.lower())


@lru_cache(maxsize=65_536)
def _stem(w: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)].rstrip("e")
    return w.rstrip("e")


def prose_of(doc: str) -> str:
    """The documentation without comment marks and without lists of parameters and returns."""
    kept, section = [], False
    for raw in _lines(doc):
        line = re.sub(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//[/!]*|#+!?|--+(?=\s)|;+|\"\"\"|''')", "", raw)
        line = re.sub(r"(?:\*+/|\"\"\"|''')\s*$", "", line)
        indent = len(line) - len(line.lstrip())
        line = line.strip()
        if not line:
            section = False
            continue
        if _SECTION.match(line):
            section = True
            continue
        if _TAGS.match(line) or _INLINE_SECTION.match(line):
            continue
        if section and (_ITEM.match(line) or indent > 0 or re.fullmatch(r"[\w\[\], .|]+", line)):
            continue
        section = False
        kept.append(line)
    return "\n".join(kept).strip()


_BEHIND_NAME = re.compile(r"(?:\(\))?`?(?=$|[\s:.,\-])[\s:\-–.]*")


def _without_name(line: str, own: str) -> str:
    """A line without the function's name before what it says; no expression is built per name."""
    at = 1 if line.startswith("`") else 0
    if not own or not line.startswith(own, at):
        return line
    m = _BEHIND_NAME.match(line, at + len(own))
    return line[m.end() :].strip() if m else line


def is_real(doc: str | None, name: str) -> bool:
    """True when the documentation says something about the function beyond its name."""
    if not doc:
        return False
    own = (name or "").split(".")[-1]
    said = []
    for line in prose_of(doc).split("\n"):
        line = _without_name(line.strip(), own)
        bare = line.strip(" \t.:;!?*-=_#~`'\"()[]")
        if not bare or _EMPTY.match(bare) or _EMPTY.match(line):
            continue
        said.append(bare)
    if not said:
        return False
    text = " ".join(said)
    if re.search(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]", text):
        return True
    return said_beyond(text, name) >= 1


def said_beyond(text: str, name: str | None) -> int:
    """How many different words of ``text`` say something beyond the name."""
    mine = {_stem(w) for w in _words((name or "").split(".")[-1])} | {_stem(w) for w in _words((name or "").replace(".", " "))}
    return len({_stem(w) for w in _words(text) if w not in _FILLER} - mine)


# --- operators ------------------------------------------------------------------------------
PAIR = "file_path string, name string, kind string, signature string, doc string, line_start int, line_end int"


def extract_pairs(raw: DataFrame, text_col: str = "content", files_col: str = "files_mentioned", distance: int = 1) -> DataFrame:
    """Every definition of every source file: (file_path, name, kind, signature, doc, line_start, line_end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["file_path", "name", "kind", "signature", "doc", "line_start", "line_end"]
        for b in batches:
            rows = [
                (path, d["name"], d["kind"], d["signature"], d["doc"], d["line_start"], d["line_end"])
                for path, text in zip(b.file_path, b.content)
                for d in extract(text, path, distance)
            ]
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({"line_start": "Int32", "line_end": "Int32"})

    files = raw.select(F.explode(F.col(files_col)).alias("file_path"), F.col(text_col).cast("string").alias("content"))
    files = files.where("file_path is not null and content is not null and content <> ''")
    return files.mapInPandas(run, PAIR)


@F.pandas_udf(BooleanType())
def _real(doc: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([is_real(d, n) for d, n in zip(doc, name)], dtype=bool)


def documented_pairs(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Code-description pairs of the listed functions and methods, without trivial ones.

    Columns: entity_id, name, signature, docstring, line_start, line_end, origin. The listed
    docstring and signature win; the file gives them where they are null. ``origin`` is file
    where the extraction found documentation, listed where only the table has it.
    """
    listed = (
        entities.where(F.col("type").isin("function", "method") & F.col("id").isNotNull())
        .groupBy(F.col("id").alias("entity_id"))
        .agg(
            F.min("name").alias("name"),
            F.min("signature").alias("listed_signature"),
            F.max(F.when(F.trim("docstring") != "", F.col("docstring"))).alias("listed_doc"),
        )
    )
    # only files that source the entities: conversations mention files without holding them
    found = extract_pairs(raw.where("source = 'file'")).where("kind <> 'class'")
    found = found.groupBy(F.concat_ws(":", "file_path", "name").alias("entity_id")).agg(
        F.min_by(F.struct("signature", "doc", "line_start", "line_end"), F.struct(F.col("doc").isNull(), "line_start")).alias("f")
    )
    return (
        listed.join(found, "entity_id", "left")
        .select(
            "entity_id",
            "name",
            F.coalesce("listed_signature", "f.signature").alias("signature"),
            F.coalesce("listed_doc", "f.doc").alias("docstring"),
            "f.line_start",
            "f.line_end",
            F.when(F.trim("f.doc") != "", "file").otherwise("listed").alias("origin"),
        )
        .where(F.col("docstring").isNotNull())
        .where(_real(F.col("docstring"), F.coalesce("name", F.lit("")).cast(StringType())))
    )


def pairs_found(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id) of each listed function or method with real documentation."""
    return documented_pairs(raw, entities).select("entity_id")
