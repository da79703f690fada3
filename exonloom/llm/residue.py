"""Template residue and error-page text (problem 9): unfilled placeholders, filler, error-page messages and scripts-required
notices where a commit message should be.

Method: message templates are mined with a fixed-depth prefix tree. Each message gives up to two units - the whole message, and
its body below the subject - and each unit its sentences, with numbers, hashes, names and slots masked. The distinct sentences hang
in a tree of fixed depth: below their number of words, their first DEPTH words (any word that names no concept is one branch).
Within a leaf, sentences that agree in SIMILAR of their words, and differ only in words without a concept, merge into one template;
a place where MIN_FILLERS different words were met becomes a wildcard. Each template is classified once, from the concepts of its
constant words (see residue_words); the verdict is propagated to its sentences and their documents by joins that salt hot sentences.
A unit is residue only if all of its sentences are.

The tree is a relation: counting the distinct sentences combines on the map side, leaves are partitions of a sorted shuffle, and a
leaf of more than LEAF_ROWS distinct sentences is mined in parts of that size. Unresolved slots inside otherwise ordinary records
are detected apart, per record and over the whole text, and reported; such records are no residue. What a message is, ends where
the diff begins: only that part of a text can carry residue."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exonloom.llm.residue_words import CLASSES, NAME, NUMBER, REPEAT, SLOT, WILD, is_latin, is_open, sentence_class
from exonloom.runtime import join_unique, write_table

#: Words of a sentence that make its path in the tree, below its length.
DEPTH = 3
#: Share of equal words at which sentences of a leaf merge, and different words that make a place variable.
SIMILAR, MIN_FILLERS = 0.5, 3
#: Distinct sentences that are merged at a time; a leaf with more is mined in parts.
LEAF_ROWS = 1000

#: Trailers of a message that are neither subject nor body.
TRAILER = re.compile(r"^\s*(?:(?:signed-off|reviewed|acked|tested|reported|suggested|approved|helped|co-authored|co-developed)-by|change-id|cc|link|refs?|reference|see-also|bug|git-svn-id)\s*:\s.*$|^\s*\((?:cherry picked|cherry-picked) from commit .*\)\s*$", re.I)
#: Subjects that tools write.
AUTOMATIC = re.compile(r"^(?:merge (?:branch|pull request|remote-tracking|tag|commit)\b|revert \"|bump \S+ (?:from|to)\b|automatic(?:ally)? \w+|auto-\w+ |scheduled \w+|nightly \w+|update lock file\b|build #|chore\(release\))", re.I)

# ---- slots ------------------------------------------------------------------------------------------------------------------

_VERB = r"(?:describe|insert|enter|add|write|explain|fill(?: in| out)?|put|type|give|state|specify|your|provide|choose|select|replace|todo|edit|name|list|mention)"
#: Unfilled slots in their usual spellings; bracketed ones reach from mark to mark.
SLOT_PATTERN = re.compile(
    "|".join(
        [
            r"<!--(?:(?!-->)[^\n])*-->", r"\{\{[^{}\n]+\}\}", r"\{%[^{}\n]+%\}", r"<%=?[^<>\n]+%>", r"<<[^<>\n]+>>", r"«[^«»\n]+»", r"[$#]\{[^{}\n]+\}", r"\{[\w .-]+\}", r"%\([\w .-]+\)s?",
            r"@@[\w .-]+@@", r"~~[\w .-]+~~", r"__[A-Za-z][A-Za-z0-9 .-]*(?:_[A-Za-z0-9]+)*__", r"\$[A-Za-z][\w.-]*\$", r"%[A-Za-z][\w.-]*%", r"<[^<>@\n]+>", r"\[\[[^\[\]\n]+\]\]", r"\[(?!(?:skip ci|ci skip|no ci|wip|[x ]|[\w-]*\d[\w.-]*)\])[^\[\]\n]+\]",
            rf"\({_VERB}\b[^()\n]*\)", r"\bxxx [\w -]+ xxx\b", r"\b[\w-]+(?: [\w-]+)? goes here\b", r"\btodo: ?(?:describe|fill in|add|write|explain|insert|enter|provide|your|put|choose|name|list|set)\b[\w ]*", r"\[object object\]",
            r"(?<![\w.])!?(?:undefined|null|nan|none|nil)(?![\w.])",
        ]
    ),
    re.I,
)
_HTML = re.compile(r"</?(?:html|head|title|body|h[1-6]|p|noscript|div|span|br|center|hr|meta|strong|b|i|em|a|ul|li|script|style|pre)\b[^<>]*>", re.I)
_HEADER_ONE = re.compile(r"^[0-9a-f]{7,40} \S.{0,80} \d{4}-\d\d-\d\d\s*$")


def message_column(text: Column) -> Column:
    """What precedes the diff; the rest of the text never leaves the JVM."""
    return F.split(text, r"(?m)^(?:diff --git |diff --cc |diff --combined |Index: |GIT binary patch|--- a/)", 2)[0]


def strip_headers(message: str) -> list[str]:
    """Lines of the message without header lines, in the layouts that occur: log, mail, one-line, none."""
    lines = re.split(r"\r\n?|\n", message)
    while lines and not lines[0].strip():
        lines.pop(0)
    if not lines:
        return []
    if re.match(r"^commit [0-9a-f]{7,64}\b|^From [0-9a-f]{40} |^(?:Author|From|Date|Subject|Commit|AuthorDate|CommitDate|Committer|To)\s*:", lines[0]):
        i, subject = 0, []
        while i < len(lines) and lines[i].strip():
            s = re.match(r"^Subject:\s*(.*)$", lines[i])
            if s:
                subject = [re.sub(r"^(?:\[PATCH[^\]]*\]\s*)+", "", s.group(1))]
                while i + 1 < len(lines) and lines[i + 1][:1] in " \t" and lines[i + 1].strip():
                    subject[0] += " " + lines[i + 1].strip()
                    i += 1
            i += 1
        lines = subject + lines[i:]
    elif _HEADER_ONE.match(lines[0]):
        lines = lines[1:]
    out = []
    for x in lines:
        if x.rstrip() == "---":
            break
        if not TRAILER.match(x):
            out.append(x.strip())
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return out


def _texts(x) -> list[str]:
    """Strings of an error reply: values of code and text keys of a nested object; anything else is no reply."""
    if isinstance(x, dict):
        out = []
        for k, v in x.items():
            if isinstance(v, (dict, list)):
                out += _texts(v)
            elif k.lower() in ("code", "status", "statuscode"):
                out.append(f"error {v}")
            elif isinstance(v, str) and k.lower() not in ("trace", "id", "request_id", "requestid", "path", "timestamp", "instance"):
                out.append(v)
        return out
    if isinstance(x, list):
        return [t for v in x for t in _texts(v)]
    return [str(x)]


@lru_cache(1 << 16)
def _masked(token: str) -> str:
    """A token with its numbers and hashes as '#', and hosts, addresses and paths as a name."""
    core = token.strip("\"'`´‘’“”.,;:!?()[]{}<>=*-–—…|/")
    if not core or core in (SLOT.strip("⟨⟩"), NUMBER):
        return token
    if re.fullmatch(r"(?=.*\d)[0-9a-f-]{4,}|[0-9a-f]{8,}|\d+(?:[.:,]\d+)*", core):
        return token.replace(core, NUMBER)
    if re.fullmatch(r"\w+://\S+|[\w.+-]+@[\w.-]+|(?:[\w-]+\.)+[a-z]\w+(?:/\S*)?|\S+/\S+/\S+", core):
        return token.replace(core, NAME)
    return token


def sentences(lines: list[str]) -> list[str]:
    """The sentences of a unit, masked and in lower case. Headings' and lists' marks go; JSON replies give their texts, HTML its text. A
    line break ends a sentence where the line is short or a paragraph ends. A unit that repeats a few words, or consists of one mashed
    key, is one sentence of its own kind."""
    text = "\n".join(re.sub(r"[ \t\u00a0\u3000]+", " ", re.sub(r"^(?:[#*=-]+\s+)+", "", x)) for x in lines).strip()
    if text[:1] == "{":
        try:
            text = "\n\n".join([*_texts(json.loads(text.split("\n\n")[0])), *text.split("\n\n")[1:]])
        except ValueError:
            pass
    bare = _HTML.sub("\n\n", text)
    if text and not bare.strip() and "</" not in text:
        return [SLOT]  # names in angle brackets that are also tags
    text = bare
    flat = re.sub(r"\s+", " ", text).strip().lower()
    words = re.findall(r"[^\W_]+", flat)
    if len(words) >= 4 and len(set(words)) <= max(1, len(words) // 3) and len(set(words)) <= 6 or re.fullmatch(r"[x._\s-]{8,}", flat) and "x" in flat or len(words) >= 4 and len(set(re.sub(r"\d+", "", flat).split())) == 1:
        return [REPEAT]
    if is_latin(words):
        return [" ".join(words)]
    text = SLOT_PATTERN.sub(f" {SLOT} ", text)
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        parts = [""]
        for line in paragraph.split("\n"):
            parts[-1] += " " + line
            if len(line) < 50:
                parts.append("")
        for p in parts:
            for x in re.split(r"(?<=[.!?…:;])\s+|(?<=[。！？])", re.sub(r"\.\s*\.\s*\.", "…", p)):
                x = " ".join(_masked(t) for t in x.lower().split())
                if re.search(r"[^\W_]|#", x):
                    out.append(x)
    return out


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, slots, sentences) of the units of each message; slots counts unresolved slots in it. Null texts, blank and empty
    messages have no unit. A message under a subject that tools write is no unit as a whole, but its body is."""

    def run(batches):
        for b in batches:
            rows = []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = strip_headers(m or "")
                slots = len(SLOT_PATTERN.findall("\n".join(lines)))
                whole = not lines or AUTOMATIC.match(lines[0]) and not SLOT_PATTERN.search(lines[0])
                for unit, part in (("message", [] if whole else lines), ("body", lines[1:])):
                    found = sentences(part)
                    if found:
                        rows.append((i, unit, slots, found))
            if rows:
                d, u, n, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(d, np.int64)), pa.array(u), pa.array(np.array(n, np.int32)), pa.array(s, pa.list_(pa.string()))], names=["doc_id", "unit", "slots", "sentences"])

    src = docs.where("doc_id is not null and text is not null").select("doc_id", message_column(F.col("text")).alias("message"))
    return src.mapInArrow(run, "doc_id long, unit string, slots int, sentences array<string>")


# ---- the tree ---------------------------------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def _open(token: str) -> bool:
    return is_open(token)


def _paths(distinct: DataFrame) -> DataFrame:
    """(sentence, n, path) of the sentences that can be residue: those that are none as they stand, and have more words without a concept
    than others, are ordinary whatever the tree says."""

    def run(batches):
        for b in batches:
            keep, path = [], []
            for k, s in enumerate(b.column(0).to_pylist()):
                tokens = s.split(" ")
                free = [_open(t) for t in tokens]
                if sum(free) <= len(tokens) / 2 or sentence_class(s):
                    keep.append(k)
                    path.append(" ".join([str(len(tokens)), *("*" if f else t for t, f in zip(tokens[:DEPTH], free))]))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep, pa.int64())) for c in b.columns), pa.array(path, pa.string())], names=["sentence", "n", "path"])

    return distinct.select("sentence", "n").mapInArrow(run, "sentence string, n long, path string")


def merge_leaf(leaf: list[list[str]]) -> list[str]:
    """The template of each sentence (as tokens, of one length) of a leaf, in order."""
    if len(leaf) == 1:
        return [" ".join(leaf[0])]
    width, codes = len(leaf[0]), {}
    rows = np.array([[codes.setdefault(t, len(codes)) for t in x] for x in leaf])
    free = np.array([[_open(t) for t in x] for x in leaf])
    tree, loose, met, of = np.zeros((len(leaf), width), int), np.zeros((len(leaf), width), bool), [], []
    for row, f in zip(rows, free):
        m = len(met)
        same = tree[:m] == row
        fits = (same | (loose[:m] & f)).all(1) & (same.sum(1) >= SIMILAR * width)
        if fits.any():
            k = int(np.argmax(np.where(fits, same.sum(1), -1)))
        else:
            k = m
            tree[k], loose[k] = row, f
            met.append([set() for _ in range(width)])
        for p in np.flatnonzero(f):
            met[k][p].add(row[p])
        tree[k][tree[k] != row] = -1
        of.append(k)
    return [" ".join(WILD if len(met[k][p]) >= MIN_FILLERS else t for p, t in enumerate(x)) for k, x in zip(of, leaf)]


def mine_templates(distinct: DataFrame) -> DataFrame:
    """(sentence, n, template): the leaf templates of distinct sentences (sentence, n). Sentences that can't be residue are left out."""
    paths = write_table(_paths(distinct), "residue-paths")
    sizes = paths.groupBy("path").agg(F.count("*").alias("m"))
    hot = sizes.where(F.col("m") > LEAF_ROWS).select("path", F.ceil(F.col("m") / LEAF_ROWS).cast("int").alias("parts"))  # hint-free: as many as fit LEAF_ROWS into the rows
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("sentence"), F.col("parts"))).cast("int")
    leaves = paths.join(hot, "path", "left").select("path", part.alias("part"), "sentence", "n")
    leaves = leaves.repartition("path", "part").sortWithinPartitions("path", "part", "sentence")

    def run(batches):
        held: list[tuple] = []

        def merged(rows):
            done = [x for _, leaf in groupby(rows, key=lambda r: r[:2]) for g in [list(leaf)] for x in zip(g, merge_leaf([r[2].split(" ") for r in g]))]
            return pa.RecordBatch.from_arrays([pa.array([r[2] for r, _ in done], pa.string()), pa.array([r[3] for r, _ in done], pa.int64()), pa.array([t for _, t in done], pa.string())], names=["sentence", "n", "template"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            last = held[-1][:2] if held else None
            cut = len(held)
            while cut and held[cut - 1][:2] == last:  # the last leaf may go on in the next batch
                cut -= 1
            if cut:
                yield merged(held[:cut])
                held = held[cut:]
        if held:
            yield merged(held)

    return leaves.mapInArrow(run, "sentence string, n long, template string")


def classify(templates: DataFrame) -> DataFrame:
    """(template, verdict) of the distinct templates of mine_templates that are residue or may stand beside it."""

    def run(batches):
        for b in batches:
            verdict = pa.array([sentence_class(t) for t in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), verdict], names=["template", "verdict"]).filter(verdict.is_valid())

    return templates.select("template").distinct().mapInArrow(run, "template string, verdict string")


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, reason, in_unit): documents whose message, or all of whose body below the subject, is residue; reason is placeholder,
    filler, error_page or scripts_required, of the whole message if that is residue, else of the body. A doc_id that occurs in
    several rows comes out once."""
    found = write_table(units(docs), "residue-units")
    distinct = found.select(F.explode("sentences").alias("sentence")).groupBy("sentence").agg(F.count("*").alias("n"))
    mined = write_table(mine_templates(distinct), "residue-templates")
    judged = write_table(join_unique(mined, classify(mined), "template").select("sentence", "n", "verdict"), "residue-verdicts")
    # a unit is residue if its first sentence is and all others are: most units leave at the first
    first = found.select("doc_id", "unit", "sentences", F.col("sentences")[0].alias("sentence"))
    some = write_table(join_unique(first, judged.drop("verdict"), "sentence", "n").select("doc_id", "unit", "sentences"), "residue-candidates")
    each = some.select("doc_id", "unit", F.xxhash64("sentences").alias("u"), F.explode("sentences").alias("sentence"))
    each = join_unique(each, judged, "sentence", "n", how="left")
    whole = each.groupBy("doc_id", "unit", "u").agg(F.bool_and(F.col("verdict").isNotNull()).alias("ok"), F.collect_set("verdict").alias("seen")).where("ok")
    has = lambda c: F.array_contains("seen", c)
    alone = F.coalesce(*[F.when(has(c), F.lit(c)) for c in CLASSES])
    reason = F.when(has("beside") & ~has("scripts_required") & ~has("error_page"), None).otherwise(alone)
    hits = whole.select("doc_id", "unit", reason.alias("reason")).where("reason is not null")
    return hits.groupBy("doc_id").agg(F.max(F.struct(F.col("unit").alias("in_unit"), "reason")).alias("v")).select("doc_id", "v.reason", "v.in_unit")


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that are left for the rest of a pipeline: all but those with a verdict."""
    return docs.join(verdicts(docs).select("doc_id"), "doc_id", "left_anti")


def open_slots(docs: DataFrame) -> DataFrame:
    """(doc_id, slots, slots_below): unresolved slots in the messages of ordinary documents, and in what follows the message; for a
    report, no ground for exclusion. Whole texts are read."""

    def run(batches):
        for b in batches:
            ids, n, below = [], [], []
            for i, t, m in zip(*(c.to_pylist() for c in b.columns)):
                a, z = len(SLOT_PATTERN.findall("\n".join(strip_headers(m)))), len(SLOT_PATTERN.findall(t[len(m) :]))
                if a or z:
                    ids.append(i), n.append(a), below.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(below, pa.int32())], names=["doc_id", "slots", "slots_below"])

    src = docs.where("doc_id is not null and text is not null").select("doc_id", "text", message_column(F.col("text")).alias("message"))
    found = src.mapInArrow(run, "doc_id long, slots int, slots_below int").groupBy("doc_id").agg(F.max("slots").alias("slots"), F.max("slots_below").alias("slots_below"))
    return found.join(verdicts(docs).select("doc_id"), "doc_id", "left_anti")
