"""Text cut off by field limits.

Two kinds of evidence, over whole texts of all documents:

* Prefix self-join (the method named). A text without its trailing mark of omission is its
  core. Of every core the prefixes of 1, 4, 16, 64, ... characters are hashed; a core joins
  the texts that share its longest such prefix, which gives them the lengths to look at, and
  the hash of exactly that many characters then tells a strict prefix of a longer text. Only
  hashes are shuffled, but for the texts that share a prefix with a shorter core. The longer
  text's next character tells whether the cut went through a word or line.
* The tail itself. A cut text whose longer copy is not in the corpus can't be found by
  a prefix join, so the end is parsed: a mark of omission, an open code block, open
  JSON, an open table row, or prose that stops inside a word or sentence.

A text is truncated when its tail is open, or when a longer copy shows that a tail that
looks complete (a list item, link, heading, table row) goes on within a word or line.

Each text is read by Python once; what it gives is written to the shared folder.

Defined cases: null, empty and blank texts are not truncated; trailing white space is
ignored; the same text under several ids is judged alike; ties and repeated rows give
each id once; a null source is reported as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.tables import cut

# matched from the end of the text backwards
_MARK = regex.compile(
    r"(?ri)(?:\s*(?:[\[(<{]\s*(?:…|\.{3,}|(?:text |output |content |message |rest |remainder )?(?:was |is )?(?:truncated|cut(?: off| short)?|snip(?:ped)?|omitted|abbreviated|shortened|continued|more|gekürzt|abgeschnitten|tronqué|coupé|truncado|recortado|cortado|截断|已截断|省略|下略|未完)[^\])>}\n]*)\s*[\])>}]"
    r"|(?:…|\.{3,}|⋯)\s*(?:\(?(?:truncated|more|continued|cut)\)?)?|\b(?:read more|show more|see more)(?:…|\.{3})?))\s*$"
)
_CLOSERS = "”\"'’)]}」』】》）*_`~»›"
_STOPS = ".!?。！？؟।…"
_BULLET = re.compile(r"^\s*(?:[-*+•‣–]|\d{1,3}[.)]|[a-zA-Z][.)]|\[[ xX]\])\s+\S")
_SUBJECT = re.compile(r"^(?:(?:re|fwd?|subject|betreff|objet|asunto)\s*:\s*\S|[a-z]+(?:\([^)\n]*\))?!?:\s\S|(?:merge|revert|bump|release)\b)", re.I)
_SIGNED = re.compile(r"^\s*(?:--|—|–|~)\s*\S")
_LINK = re.compile(r"^\s*(?:\[[^\]]*\]:?\s*)?<?(?:https?://|www\.)?[^\s<>]*[/.][^\s<>]*>?\s*$")
_KEYED = re.compile(r"^\s*[\w .\-]{1,40}:\s*\S")
_GREETING = re.compile(r"(?i)^(?:thanks|thank you|cheers|regards|best(?: regards| wishes)?|kind regards|sincerely|greetings|mit freundlichen grüßen|viele grüße|grüße|cordialement|bien à vous|saludos|atentamente|谢谢|此致|敬礼)\b")


def without_mark(text: str) -> tuple[str, bool]:
    """The text without trailing space and mark of omission, and whether there was a mark."""
    bare = text.rstrip()
    m = _MARK.match(bare)
    return (bare[: m.start()].rstrip(), True) if m and m.start() > 0 else (bare, False)


def _json_open(text: str) -> bool:
    depth, at, n = 0, 0, len(text)
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|"', text):
        c = m[0]
        if c == '"':
            return True  # a string that is never closed
        if c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        at = m.end()
    return depth > 0 or (at < n and bool(text[at:].strip().rstrip(",")) and depth > 0)


def tail_state(text: str | None) -> str:
    """How a text ends: ``open``, ``complete``, ``loose`` (complete by form alone) or ``blank``."""
    if text is None or not text.strip():
        return "blank"
    bare, mark = without_mark(text)
    if mark:
        return "open"
    fences = re.findall(r"(?m)^[ \t]*(?:```|~~~)", bare)
    if len(fences) % 2:
        return "open"
    if re.match(r"^\s*(?:\{\s*(?:\"|\}|$)|\[\s*(?:[\"\[{\]\d\-]|true|false|null|$))", bare) and not re.match(r"^\s*\[[^\]\n]*\]\(", bare):
        if _json_open(bare):
            return "open"
        if bare[-1] in "}]":
            return "complete"
    lines = bare.split("\n")
    last = lines[-1].strip("\r")
    if last.strip()[-1:] in ("}", "]") and (block := re.search(r"(?s).*^([\[{].*)", bare, re.M)) and not _json_open(block[1]):
        return "complete"  # a record at the end of a text
    if re.match(r"^\s*(?:```|~~~)", last):
        return "complete"
    if last.lstrip().startswith("|"):
        return "complete" if last.rstrip().endswith("|") and last.strip() != "|" else "open"
    core = last.rstrip().rstrip(_CLOSERS)
    if bare[-1] in _STOPS or (core and core[-1] in _STOPS):
        return "complete"
    if bare[-1] in ",;，、；:：-–—(（[{</\\|&+=“„«「『《" and not _BULLET.match(last) and not re.fullmatch(r"\s*(?:[-=*_]\s*){3,}", last):
        return "open"
    if re.fullmatch(r"\s*(?:[-=*_]\s*){3,}", last) or last.lstrip().startswith(("#", ">", "<")) or last.startswith(("    ", "\t")):
        return "loose"
    if _BULLET.match(last) or _SIGNED.match(last) or _LINK.match(last) or _GREETING.match(last):
        return "loose"
    if re.match(r"^[a-z]+\([^)\n]*\)!?:\s\S", last) and len(last) <= 100:
        return "loose"
    if any(_GREETING.match(g) and len(g) <= 40 and all(len(x) <= 60 for x in lines[-i:]) for i, g in enumerate(reversed(lines[-4:])) if i):
        return "loose"  # name, place or firm under a greeting
    own_paragraph = len(lines) == 1 or not lines[-2].strip()
    if _SUBJECT.match(last) and own_paragraph and len(last) <= 100:
        return "loose"
    if own_paragraph and len(lines) > 1 and len(last) <= 60 and (_KEYED.match(last) or _SIGNED.match(lines[-1])):
        return "loose"
    return "open"


BROADCAST_IDS = 2_000_000  # at 8 bytes each
STEP = 4  # each hashed prefix is so many times as long as the one before


def _hash(text: str) -> int:
    """The same as Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def ladder(core: str) -> list[int]:
    """Hashes of the prefixes of 1, STEP, STEP ** 2, ... characters that the text has."""
    out, n = [], 1
    while n <= len(core):
        out.append(_hash(core[:n]))
        n *= STEP
    return out


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, n, tail, core_n, h, ladder): how each text ends; length, hash and prefix hashes of its core."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [None if t is None else str(t) for t in b.text]
            cores = ["" if t is None else without_mark(t)[0] for t in texts]
            yield pd.DataFrame(
                {
                    "doc_id": b.doc_id,
                    "source": b.source,
                    "n": pd.array([None if t is None else len(t) for t in texts], "Int64"),
                    "tail": [tail_state(t) for t in texts],
                    "core_n": [len(c) for c in cores],
                    "h": [_hash(c) for c in cores],
                    "ladder": [ladder(c) for c in cores],
                }
            )

    some = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("string").alias("text"))
    kind = dict(some.dtypes)["doc_id"]
    return some.mapInPandas(run, f"doc_id {kind}, source string, n long, tail string, core_n int, h long, ladder array<long>")


def prefix_hits(documents: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(core_n, h, goes_on): every core that is a strict prefix of another; goes_on: the other goes on in the same line."""
    # a copied text counts once
    cores = judged.where("core_n > 0").groupBy("core_n", "h").agg(F.min_by(F.struct("doc_id", "ladder"), "doc_id").alias("r")).select("core_n", "h", "r.doc_id", "r.ladder")
    short = cores.groupBy((F.size("ladder") - 1).alias("level"), F.element_at("ladder", -1).alias("key")).agg(F.collect_set("core_n").alias("lengths"))  # fewer than STEP ** (level + 1)
    long = cores.select("doc_id", "core_n", "h", F.posexplode("ladder").alias("level", "key"))
    asked = long.join(short, ["level", "key"]).select("doc_id", F.col("core_n").alias("own_n"), F.col("h").alias("own"), F.filter("lengths", lambda x: x < F.col("core_n")).alias("lengths"))
    asked = cut(asked.where(F.size("lengths") > 0))
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if asked.count() <= BROADCAST_IDS:  # then only the texts asked for are shuffled; beyond, all are
        texts = texts.join(F.broadcast(asked.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.join(asked, "doc_id")
    same = texts.where(F.xxhash64(F.expr("substring(text, 1, own_n)")) == F.col("own")).select("text", F.explode("lengths").alias("core_n"))
    heads = same.select("core_n", F.xxhash64(F.expr("substring(text, 1, core_n)")).alias("h"), (~F.expr("substring(text, core_n + 1, 1)").isin("\n", "\r")).alias("goes_on"))
    found = heads.groupBy("core_n", "h").agg(F.max("goes_on").alias("goes_on"))
    return found.join(cores.select("core_n", "h"), ["core_n", "h"], "left_semi")


def truncated_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, n, tail, has_longer_copy, truncated) of every document."""
    judged = cut(judge(documents))
    return (
        judged.select("doc_id", "source", "n", "tail", "core_n", "h")
        .join(prefix_hits(documents, judged), ["core_n", "h"], "left")
        .select(
            "doc_id",
            "source",
            "n",
            "tail",
            F.col("goes_on").isNotNull().alias("has_longer_copy"),
            ((F.col("tail") == "open") | ((F.col("tail") == "loose") & F.coalesce("goes_on", F.lit(False)))).alias("truncated"),
        )
    )


def truncated_found(documents: DataFrame) -> DataFrame:
    """(doc_id) of each document whose text was cut off."""
    return truncated_documents(documents).where("truncated").select("doc_id").distinct()


def united_source(col) -> F.Column:
    """Spellings of a source united: case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-_]+", "_")


def truncation_rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, n_by_copy, n_by_tail, rate, usual_limit): how often each source truncates, by which evidence, and at which length most.

    A truncated text counts by copy where a longer one is there, else by its tail.
    """
    d = truncated_documents(documents).withColumn("source", united_source(F.col("source")))
    t = F.col("truncated").cast("long")
    per = d.groupBy("source", "n").agg(F.count("*").alias("c"), F.sum(t).alias("t"), F.sum(t * F.col("has_longer_copy").cast("long")).alias("by_copy"))
    usual = F.max(F.when(F.col("t") > 0, F.struct("t", "n")))["n"]
    rates = per.groupBy("source").agg(F.sum("c").alias("n_docs"), F.sum("t").alias("n_truncated"), F.sum("by_copy").alias("n_by_copy"), usual.alias("usual_limit"))
    return rates.select("source", "n_docs", "n_truncated", "n_by_copy", (F.col("n_truncated") - F.col("n_by_copy")).alias("n_by_tail"), (F.col("n_truncated") / F.col("n_docs")).alias("rate"), "usual_limit")
