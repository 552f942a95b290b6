"""Screening of files or documents before release: by path, then by content."""

from __future__ import annotations

import subprocess
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Content patterns and the counts from which they speak.
CLINICAL_HEADER = r"(?i)Admission Date|Discharge Date|CHIEF COMPLAINT|HISTORY OF PRESENT"
NOTE_MARKER, NOTE_MARKERS = r"\[\*\*[^\]*]{1,40}\*\*\]", 5
HANGUL_PROSE, HANGUL_RUNS = r"[가-힣]{2,}[ ,.·][가-힣]{2,}[ ,.·][가-힣]{2,}", 3
SEALED_PREFIX = "sealed/"
DENY = (
    r"^data/",
    r"(^|/)data/(source|derived|raw|interim)/",
    r"(^|/)[^/]*surrogate[^/]*\.(jsonl|json|csv|tsv|txt)$",
    r"(^|/)[^/]*value_map[^/]*\.(jsonl|json|csv|tsv)$",
    r"(^|/)[^/]*_tagged[^/]*\.(jsonl|json|csv|tsv|txt)$",
    r"(^|/)[^/]*_with_text[^/]*",
    r"(^|/)[^/]*_raw_llm[^/]*",
    r"(^|/)call_logs?/",
    r"(^|/)raw_responses[^/]*",
    r"(^|/)critic_log\.jsonl$",
    r"(^|/)agent_calls\.jsonl$",
    r"(^|/)audit_report\.json$",
    r"(^|/)errors\.jsonl$",
    r"(^|/)prompts?/(filled|rendered)/",
    r"(^|/)[^/]*\.(filled|rendered)\.[^/]+$",
    r"(^|/)[^/]*_(filled|rendered)_prompt[^/]*",
    r"(^|/)[^/]*prompt[^/]*_iter[0-9]+[^/]*",
)
ALLOW = (
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/metrics\.json$",
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/spans\.jsonl$",
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/iter[0-9]+/metrics\.json$",
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/iter[0-9]+/spans\.jsonl$",
    r"^results/sealed_eval_log\.md$",
    r"^results/[^/]+/[^/]+/[^/]+/port-human/human_log\.jsonl$",
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/window_freeze\.json$",
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/rules/iter[0-9]+/[^/]+\.ya?ml$",
    r"^results/[^/]+/[^/]+/[^/]+/[^/]+/format_failure\.json$",
)
RULE_FILE = r"(^|/)rules/(iter[0-9]+/)?[^/]+\.ya?ml$"
RULE_ID_LINE = r"""(?m)^[ \t]*-?[ \t]*["']?rule_id["']?[ \t]*:[ \t]*["']?([^"'\r\n#]*)"""
NAME_LONGEST, NAME_MOST_PARTS, NAME_CODE = 40, 5, "^(v[0-9]{1,2}|[0-9]{1,2}[a-z]{0,8})$"
EXCEPT = (r"^data/README\.md$", r"^data/[^/]+/README\.md$", r"^data/acquire/fetch_[^/]+\.sh$")


def _any(c: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def denied(path: Column) -> Column:
    return path.startswith(SEALED_PREFIX) | (_any(path, DENY) & ~_any(path, EXCEPT))


def content_reason(text: Column, rules: Sequence[tuple[str, str, int]] = ()) -> Column:
    """Why a text is suspect, or null; rules add (name, pattern, least number of matches) behind the fixed ones."""
    fixed = (("clinical_header", CLINICAL_HEADER, 1), ("note_markers", NOTE_MARKER, NOTE_MARKERS), ("hangul_prose", HANGUL_PROSE, HANGUL_RUNS))
    out = F.lit(None).cast("string")
    for name, pattern, least in reversed((*fixed, *rules)):
        hit = text.rlike(pattern) if least == 1 else F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) >= least
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def without_code_prose(text: Column) -> Column:
    """Python source without its docstrings and comments."""
    strings = F.regexp_replace(text, r"(?s)(\"\"\"|''').*?\1", "")
    return F.regexp_replace(strings, r"(?m)#[^\n]*$", "")


def strange_name(name: Column, lang: Column, words: Sequence[str], by_lang: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Why a rule's name isn't put together from words of the vocabulary, or null.

    A name's prefix is left out.  The words of the file's language count too, unless
    the name has a prefix of another.
    """
    cut = F.instr(name, ":")
    body = F.when(cut > 0, F.substring(name, cut + 1, F.length(name))).otherwise(name)
    own = F.lit(None).cast("array<string>")
    for code, extra in sorted((by_lang or {}).items()):
        fits = (F.lower(lang) == code) & ((cut == 0) | (F.lower(F.trim(F.substring_index(name, ":", 1))) == code))
        own = F.when(fits, F.array(*(F.lit(w.lower()) for w in extra))).otherwise(own)
    parts = F.filter(F.split(F.lower(body), "[_-]"), lambda x: x != "")
    known = F.array(*(F.lit(w.lower()) for w in words)).cast("array<string>")
    left = F.filter(F.array_except(parts, F.concat(known, F.coalesce(own, F.array().cast("array<string>")))), lambda x: ~x.rlike(NAME_CODE))
    return (
        F.when(F.size(parts) == 0, "empty")
        .when(body.rlike(r"\p{Lu}"), "capital")
        .when(body.rlike("[0-9]{3,}"), "number")
        .when(body.rlike(r"[^\x00-\x7f]"), "not_ascii")
        .when(F.length(body) > NAME_LONGEST, "long")
        .when(F.size(parts) > NAME_MOST_PARTS, "many_parts")
        .when(F.size(left) > 0, "unknown_word")
    )


def strange_names(names: DataFrame, words: Sequence[str], by_lang: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """names: rule_id, lang.  The rows whose name is refused, with the reason."""
    return names.withColumn("reason", strange_name(F.col("rule_id"), F.col("lang"), words, by_lang)).where("reason is not null")


def screen_files(files: DataFrame, rules: Sequence[tuple[str, str, int]] = (), words: Sequence[str] | None = None, by_lang: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """files: path, content, visible.  path, class (blocked, sealed, quarantined, suspect, allowed), reason, listed.

    ``listed`` tells whether an allow pattern names the path.  With a vocabulary the
    names in rule files are looked at first.
    """
    path, content = F.col("path"), F.col("content")
    out = denied(path)
    prose = content_reason(F.when(path.endswith(".py"), without_code_prose(content)).otherwise(content), rules)
    if words is not None:
        lang = F.lower(F.regexp_extract(path, r"([^/]+)\.ya?ml$", 1))
        ids = F.filter(F.transform(F.regexp_extract_all(content, F.lit(RULE_ID_LINE), F.lit(1)), F.trim), lambda x: x != "")
        bad = F.exists(ids, lambda x: strange_name(x, lang, words, by_lang).isNotNull())
        prose = F.when(path.rlike(RULE_FILE) & bad, "rule_id shape").otherwise(prose)
    why = F.when(~out, prose)
    kind = (
        F.when(out & F.col("visible"), "blocked")
        .when(out & path.startswith(SEALED_PREFIX), "sealed")
        .when(out, "quarantined")
        .when(why.isNotNull(), "suspect")
        .otherwise("allowed")
    )
    return files.select("path", kind.alias("class"), why.alias("reason"), _any(path, ALLOW).alias("listed"))


def check_allowlist(entries: DataFrame) -> DataFrame:
    """entries: path, sniff, why.  The entries with fault, null for those that are in order.

    An entry names one file outside data/, sealed/ and every denied path, the hit that
    is expected, and a reason of five words.
    """
    path = F.coalesce("path", F.lit(""))
    fault = (
        F.when(path == "", "no path")
        .when(path.rlike(r"[*?\[\]]|/$"), "pattern")
        .when(path.startswith("data/") | path.startswith(SEALED_PREFIX), "sealed or data")
        .when(denied(path), "denied")
        .when(F.coalesce("sniff", F.lit("")) == "", "no sniff")
        .when(F.size(F.filter(F.split(F.coalesce("why", F.lit("")), r"\s+"), lambda x: x != "")) < 5, "no reason")
    )
    return entries.select("path", "sniff", "why", fault.alias("fault"))


def partition_suspect(screened: DataFrame, allowlist: DataFrame, files: DataFrame) -> DataFrame:
    """path, reason, part: known (an entry expects this hit), unexpected, unpublishable (not visible), stale (an entry without its file).

    screened: as from screen_files; files: path, visible; an entry with a fault is refused.
    """
    checked = check_allowlist(allowlist)
    entry = checked.select(F.col("path").alias("p"), F.when(F.col("fault").isNull(), F.col("sniff")).otherwise(F.raise_error(F.concat(F.lit("allowlist: "), F.col("fault"))).cast("string")).alias("sniff"))
    hits = screened.where("class = 'suspect'").join(files.select("path", "visible"), "path").join(entry, F.col("path") == F.col("p"), "left")
    part = F.when(F.col("reason").startswith(F.col("sniff")), "known").when(F.col("visible"), "unexpected").otherwise("unpublishable")
    gone = entry.join(files.select(F.col("path").alias("f")), F.col("p") == F.col("f"), "left_anti")
    return hits.select("path", "reason", part.alias("part")).unionByName(gone.select(F.col("p").alias("path"), F.lit(None).cast("string").alias("reason"), F.lit("stale").alias("part")))


def screen_history(objects: DataFrame) -> DataFrame:
    """objects: sha, path, kind, all that a repository ever held.  Denied files among them: sha (ten characters), path."""
    return objects.where((F.col("kind") == "blob") & denied(F.col("path"))).select(F.substring("sha", 1, 10).alias("sha"), "path")


def history(spark: SparkSession, repository: str) -> DataFrame:
    """sha, path, kind of every object of a repository's history, one batch call to git."""
    run = lambda *a, **k: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True, check=True, **k).stdout
    named = [x.split(" ", 1) for x in run("rev-list", "--objects", "--all").splitlines() if " " in x]
    kinds = dict(x.split()[:2] for x in run("cat-file", "--batch-check", input="".join(f"{sha}\n" for sha, _ in named)).splitlines())
    return spark.createDataFrame([(sha, path, kinds.get(sha)) for sha, path in named], "sha string, path string, kind string")


def screen_documents(docs: DataFrame, rules: Sequence[tuple[str, str, int]] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class (suspect or allowed), reason."""
    why = content_reason(F.coalesce(F.col(text), F.lit("")), rules)
    return docs.select(docs[doc_id].alias("doc_id"), F.when(why.isNotNull(), "suspect").otherwise("allowed").alias("class"), why.alias("reason"))


def file_tree(spark, root: str) -> DataFrame:
    """path (below root), content, visible of every file of a tree."""
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("path", f"^.*?{base}", "").alias("path"), F.decode("content", "UTF-8").alias("content"), F.lit(True).alias("visible"))
