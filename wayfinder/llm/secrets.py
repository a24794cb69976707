"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text, every rule by a digest of what
it matches. A scan looks only for (blob, rule) pairs that are not in the ledger, and findings are
joined back to all paths that hold the blob. The ledger has a row for each blob of each scan, with
the rules it was scanned for and what they found; a changed or new rule is a pair not yet seen.

Offsets are code points, the end exclusive. A rule's matches are leftmost and do not overlap;
positions come from the pieces between them, which are the text split at the same pattern.
Nulls: a null text is the empty text; a null path is a path. Empty texts have no findings, texts of
any length are scanned whole. Rows that repeat are paths of one blob, scanned once. Findings that
start together stand in the order of the rules. Empty tables give empty results. Other columns are
never read, so their names cannot clash; paths must not be named blob or spans.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfinder.functions.scratch import Scratch
from wayfinder.llm._shared import let


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + "|" + either_case("api") + "_?" + either_case("key")


@dataclass(frozen=True)
class Rule:
    """kind; pattern; the least characters of `group` (0: the whole match); a plain string that any match holds, or a cheap pattern for it."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    hint: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.least, self.group)).encode()).hexdigest()[:16]


BASE = (
    Rule("assign", rf"({KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, r"[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 24, 0, r"[0-9a-f]{24}"),
)
#: The rules that the method adds to the base ones.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, r"gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, r"xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, r"eyJ"),
)
#: Rows of addresses or findings (under 200 bytes each) are broadcast up to so many; beyond, joined with a shuffle.
BROADCAST_BLOBS = 50_000
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
HELD = "array<struct<start:int,end:int,rule:string>>"


def matches(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, order, kind, end) of a rule's findings in a text; texts without the hint are not matched."""

    def of(found):
        def cut(pieces):
            lengths = lambda a: F.transform(a, lambda x: F.length(x))
            # each match starts after the pieces up to it and the matches before it
            steps = F.zip_with(lengths(F.slice(pieces, 1, F.size(found))), lengths(found), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

            def go(s, x):
                start = s["at"] + x["gap"]
                return F.struct((start + x["n"]).alias("at"), F.concat(s["spans"], F.array(F.struct(start.alias("start"), (start + x["n"]).alias("end")))).alias("spans"))

            return F.aggregate(steps, zero, go, lambda s: s["spans"])

        spans = let(F.split(text, rule.pattern, -1), cut)
        held = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        whole = F.zip_with(spans, held, lambda s, x: F.when(F.length(x) >= rule.least, F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"))))
        return F.when(F.size(found) > 0, F.filter(whole, lambda x: x.isNotNull()))

    hit = text.rlike(rule.hint) if any(c in rule.hint for c in "[({\\") else text.contains(rule.hint)
    found = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), of)
    return F.coalesce(F.when(hit, found.cast(SPANS)), F.array().cast(SPANS))


def spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All findings of the rules in a text, by start, then in the order of the rules."""
    return F.array_sort(F.concat(*(matches(text, r, k) for k, r in enumerate(rules))))


def digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_BLOBS else rows


def scan(versions: DataFrame, paths: list[str], text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all versions and the ledger that follows.

    versions: a row for each version of a path; `paths` names the columns that tell them apart.
    ledger: `(blob, rules, spans)` from earlier scans; pairs of a blob and a rule in it are not scanned again.
    Returns `(*paths, blob, spans)` with a row for each row of `versions`, and the new ledger.

    Of a blob's paths only the first is read again, where a rule has not seen the blob. Texts are
    scanned where they lie: the addresses of what is to be scanned, or if all want the same rules
    of what is not, meet them by broadcast when they are few; only if both are many are texts
    shuffled. Findings are joined by address; they have one row a blob.
    """
    scratch = Scratch(versions.sparkSession, "secrets")
    body, key = F.coalesce(F.col(text), F.lit("")), F.struct(*paths)
    wanted = F.array(*(F.lit(r.version) for r in rules)) if rules else F.array().cast("array<string>")
    named = scratch.cut(versions.select(key.alias("_wf_path"), F.sha2(body, 256).alias("blob")), "named")
    first = named.groupBy("blob").agg(F.min("_wf_path").alias("_wf_path"))
    if ledger is None:
        todo = first.withColumn("rules", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))  # a row for each scan of a blob
        todo = first.join(seen, "blob", "left").select("blob", "_wf_path", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where("size(rules) > 0")
    todo = scratch.cut(todo, "todo")
    at = [F.to_json("_wf_path").alias("_wf_at"), "blob"]
    texts = versions.select(F.to_json(key).alias("_wf_at"), F.sha2(body, 256).alias("blob"), body.alias("_wf_text"))
    alike = todo.select("rules").distinct().limit(2).collect()
    none = F.array().cast(SPANS)
    held = lambda found, of: F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(F.array(*(F.lit(r.version) for r in of)), x["rank"]).alias("rule")))
    done = named.join(todo.select(*at[1:], "_wf_path"), ["blob", "_wf_path"], "left_anti")
    if len(alike) == 1 and done.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS:
        mine = [r for r in rules if r.version in set(alike[0]["rules"])]
        unseen = texts.join(F.broadcast(done.select(*at).distinct()), ["_wf_at", "blob"], "left_anti")
        found = unseen.select("blob", F.array(*(F.lit(r.version) for r in mine)).alias("rules"), held(spans(F.col("_wf_text"), tuple(mine)), mine).alias("spans"))
    else:
        unseen = texts.join(_few(todo.select(*at, "rules")), ["_wf_at", "blob"])
        parts = [F.when(F.array_contains("rules", r.version), matches(F.col("_wf_text"), r, k)).otherwise(none) for k, r in enumerate(rules)]
        found = unseen.select("blob", "rules", held(F.concat(none, *parts), rules).alias("spans"))
    fresh = scratch.cut(found.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").cast(HELD).alias("spans")), "ledger")
    after = fresh if ledger is None else ledger.select("blob", "rules", "spans").unionByName(fresh)
    place = lambda x: (F.array_position(wanted, x["rule"]) - 1).cast("int")
    kinds = F.array(*(F.lit(r.kind) for r in rules)) if rules else F.array().cast("array<string>")
    told = after.where("size(spans) > 0").groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("_wf_spans"))
    mine = F.filter("_wf_spans", lambda x: F.array_contains(wanted, x["rule"]))
    mine = F.array_sort(F.transform(mine, lambda x: F.struct(x["start"].alias("start"), place(x).alias("rank"), F.get(kinds, place(x)).alias("kind"), x["end"].alias("end"))))
    told = scratch.cut(told.select("blob", mine.alias("spans")).where("size(spans) > 0"), "told")
    joined = named.join(_few(told), "blob", "left")
    return joined.select("_wf_path.*", "blob", F.coalesce("spans", none).alias("spans")), after


def redact(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every finding, overlaps joined, replaced by a mark; null and clean texts stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, x):
        new = x["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        out = F.when(new, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    cleaned = F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, cleaned).otherwise(text)


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, ledger: DataFrame | None = None) -> DataFrame:
    """`docs(text, ...)` with every finding replaced by a mark, and n_chars, where there is one, counted again.

    Findings come from the ledger scan by address; only blobs with findings are joined back, so
    that of a clean document nothing but its address meets them.
    """
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    path = "doc_id" if "doc_id" in docs.columns else "text"
    found, _ = scan(docs.select(*{path, "text"}), [path], rules=rules, ledger=ledger)
    found = found.where("size(spans) > 0").select(F.col("blob").alias("_wf_blob"), F.col("spans").alias("_wf_spans")).dropDuplicates(["_wf_blob"])
    found = Scratch(docs.sparkSession, "redact").cut(found, "found")
    joined = docs.withColumn("_wf_blob", blob).join(_few(found), "_wf_blob", "left")
    marked = F.col("_wf_spans").isNotNull()
    joined = joined.withColumn("text", F.when(marked, redact(F.col("text"), F.col("_wf_spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        joined = joined.withColumn("n_chars", F.when(marked, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
