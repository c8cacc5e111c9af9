"""Columns that take code, fields and verdicts out of raw responses and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import bound, digest

#: Wording by which responses and logs are taken apart (fixed values).
THINK = r"(?s)<think>.*?</think>"
TAGS = r"</?(?:answer|think)>"
FENCE = r"(?s)```(?:[a-zA-Z+./-]+)?[ \t]*\n?(.*?)```"
VERILOG_FENCE = r"(?s)```(?:verilog|systemverilog)?\s*"
ANSWER = r"(?s)<answer>(.*?)</answer>"


def _every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def regions(raw: Column) -> Column:
    """Where code may be: closed fences, then [BEGIN] to [DONE] without fence lines, then what follows an unclosed fence."""
    def found(t: Column) -> Column:
        marked = F.transform(_every(t, r"(?s)\[BEGIN\](.*?)\[DONE\]", 1), lambda x: F.regexp_replace(x, r"(?m)^[ \t]*```.*$", ""))
        open_tail = bound(F.split(t, "```"), lambda p: F.when(F.size(p) % 2 == 0, F.array(F.element_at(p, -1))).otherwise(F.array().cast("array<string>")))
        return F.concat(_every(t, FENCE, 1), marked, open_tail)

    return bound(F.regexp_replace(F.regexp_replace(raw, THINK, ""), TAGS, ""), found)


def _whole(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda r: _every(r, r"(?s)\bmodule\b.*?endmodule")))


def complete_modules(raw: Column) -> Column:
    """Whole modules of every region, in order."""
    return _whole(regions(raw))


def picked_module(raw: Column) -> Column:
    """(code, status): the last whole module, else the last one that lacks its end, else nothing."""
    cut = lambda parts: F.flatten(F.transform(F.filter(parts, lambda r: ~F.contains(r, F.lit("endmodule"))), lambda r: _every(r, r"(?s)\bmodule\b.*")))
    some = lambda code, status: F.struct(_stripped(F.element_at(code, -1)).alias("code"), F.lit(status).alias("status"))
    nothing = F.struct(F.lit("").alias("code"), F.lit("empty").alias("status"))
    second = lambda parts: bound(cut(parts), lambda c: F.when(F.size(c) > 0, some(c, "truncated")).otherwise(nothing))
    return bound(regions(raw), lambda parts: bound(_whole(parts), lambda w: F.when(F.size(w) > 0, some(w, "complete")).otherwise(second(parts))))


def module_candidates(raw: Column) -> Column:
    """Different whole modules, the last first."""
    return F.filter(F.array_distinct(F.reverse(F.transform(complete_modules(raw), _stripped))), lambda x: x != "")


def picked_kernel(raw: Column) -> Column:
    """(code, status): the longest fenced block with a compiled kernel; partial for a fragment, empty without any block."""
    longest = lambda x: F.reduce(x, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    some = lambda code, status: F.struct(code.alias("code"), F.lit(status).alias("status"))

    def chosen(blocks: Column) -> Column:
        jit = F.filter(blocks, lambda b: F.contains(b, F.lit("@triton.jit")))
        whole = F.filter(jit, lambda b: b.rlike(r"\bdef\b"))
        return F.when(F.size(blocks) == 0, some(F.lit(""), "empty")).when(F.size(whole) > 0, some(_stripped(longest(whole)), "complete")).when(F.size(jit) > 0, some(_stripped(longest(jit)), "partial")).otherwise(some(F.lit(""), "partial"))

    return bound(_every(answer_body(raw), FENCE, 1), chosen)


def recoverable(new: Column, status: Column, old: Column, end: str | None = "endmodule") -> Column:
    """Whether a code found anew may replace the old one: whole, different, and the old one missing, without its end, or over 5 % shorter."""
    o = F.coalesce(old, F.lit(""))
    better = (o == "") | (F.length(new) > F.length(o) * 1.05)
    if end is not None:
        better = better | ~F.contains(o, F.lit(end))
    return F.coalesce((status == "complete") & (new != "") & ((o == "") | (_stripped(new) != _stripped(o))) & better, F.lit(False))


def first_verilog(raw: Column) -> Column:
    """Code of the first fence (an unclosed one reaches to the end; without any the whole text), cut to its modules."""
    t = F.regexp_replace(F.regexp_replace(raw, THINK, ""), TAGS, "")
    closed = VERILOG_FENCE + "(.*?)```"
    code = F.when(t.rlike(closed), F.regexp_extract(t, closed, 1)).when(t.rlike(VERILOG_FENCE), F.regexp_extract(t, VERILOG_FENCE + "(.*)$", 1)).otherwise(t)
    whole, cut = F.regexp_extract(code, r"(?s)(module\b.*endmodule)", 1), F.regexp_extract(code, r"(?s)(module\b.*)", 1)
    return F.coalesce(F.nullif(whole, F.lit("")), F.nullif(cut, F.lit("")), code)


def fenced_or_module(raw: Column) -> Column:
    """Body of the first fence, else the first whole module, else nothing."""
    body, whole = F.regexp_extract(raw, FENCE, 1), F.regexp_extract(raw, r"(?s)(module\s+\w+.*?endmodule)", 1)
    return F.when(raw.rlike(FENCE), _stripped(body)).otherwise(_stripped(whole))


def strip_reasoning(text: Column) -> Column:
    """Without closed reasoning, whatever its case, and without what ends at the first lone closing tag; leading line ends dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)\A.*?</think>", ""), r"\A\n+", "")


def answer_body(text: Column) -> Column:
    """What the answer tags hold; without them the text as it is."""
    return F.when(text.rlike(ANSWER), _stripped(F.regexp_extract(text, ANSWER, 1))).otherwise(text)


def think_and_answer(text: Column) -> Column:
    """(think, answer), each empty without its tags."""
    return F.struct(_stripped(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1)).alias("think"), _stripped(F.regexp_extract(text, ANSWER, 1)).alias("answer"))


def strip_fence(text: Column) -> Column:
    """Body of the first fence, or the text."""
    return F.when(text.rlike(FENCE), _stripped(F.regexp_extract(text, FENCE, 1))).otherwise(_stripped(text))


def strip_dryrun(text: Column) -> Column:
    """Without the marker line of a dry run and its closing [END]."""
    body = F.regexp_replace(F.regexp_replace(F.ltrim(text), r"\A[^\n]*\n?", ""), r"(?:\A|\n)[ \t]*\[END\]\s*\z", "")
    return F.when(F.regexp_replace(text, r"^\s+", "").startswith("[DRYRUN"), _stripped(body)).otherwise(text)


def python_block(text: Column) -> Column:
    """Body of the first Python fence; empty without one."""
    return _stripped(F.regexp_extract(text, r"(?is)```(?:python|py)[ \t]*\n(.*?)```", 1))


def force_module_name(code: Column, name: Column) -> Column:
    """The code with the first module renamed."""
    return F.regexp_replace(code, F.lit(r"(?s)^(.*?)\bmodule\s+\w+"), F.concat(F.lit("$1module "), name))


def last_field(log: Column, name: str, number: str = r"\d+") -> Column:
    """The last ``name = number`` of a log; null without one."""
    return F.try_element_at(_every(log, rf"{name}\s*=\s*({number})", 1), F.lit(-1)).try_cast("double")


def response_section(log: Column) -> Column:
    """What stands between the headings Response and Statistics, without rules and blank lines around it; empty without the first."""
    begin = F.instr(log, F.lit("\nResponse\n"))
    behind = F.substr(log, begin + F.lit(len("\nResponse\n")))
    end = F.instr(F.concat(F.lit("\n"), behind), F.lit("\nStatistics\n"))
    body = F.when(end > 0, F.substr(behind, F.lit(1), F.greatest(end - 2, F.lit(0)))).otherwise(behind)
    inner = F.regexp_replace(F.regexp_replace(body, r"\A(?:[ \t\r]*(?:-*|Response)[ \t\r]*(?:\n|\z))+", ""), r"(?:(?:\n|\A)[ \t\r]*-*[ \t\r]*)+\z", "")
    return F.when(begin > 0, inner).otherwise("")


def mismatch_passed(log: Column) -> Column:
    """Whether the first mismatch count of a log is 0."""
    return F.regexp_extract(log, r"Mismatches:\s*(\d+)\s+in\s+\d+\s+samples", 1).rlike("^0+$")


def solution_passed(log: Column) -> Column:
    """A pass is announced, nothing speaks of a mismatch, and no count of mismatches is positive."""
    positive = F.exists(_every(log, r"(?i)Mismatches:\s*(\d+)", 1), lambda n: n.rlike("[1-9]"))
    return (F.contains(log, F.lit("Your Design Passed")) | F.contains(log, F.lit("Mismatches: 0"))) & ~F.contains(log, F.lit("MISMATCH")) & ~positive


def six_numbers(log: Column, label: str = "task_level:module", last: bool = False) -> Column:
    """Numbers of the first (or last) line that begins with a label; null without one of at least four."""
    lines = _every(log, rf"(?m)^{label}(.*)$", 1)
    parts = F.transform(F.split(F.trim(F.try_element_at(lines, F.lit(-1 if last else 1))), r"\s+"), lambda x: x.try_cast("double"))
    return F.when(F.size(parts) >= 4, parts)


def control_signature(rtl: Column) -> Column:
    """Digest of five counts of control structure."""
    count = lambda p: F.regexp_count(rtl, F.lit(p)).cast("string")
    counts = {"always": count(r"(?i)\balways\b"), "case": count(r"(?i)\bcase[xz]?\b"), "if": count(r"(?i)\bif\s*\("), "nonblocking": count("<="), "registers": count(r"(?i)\b(reg|logic)\b")}
    return digest(F.concat(F.lit("["), F.concat_ws(", ", *[F.concat(F.lit(f"('{k}', "), v, F.lit(")")) for k, v in counts.items()]), F.lit("]")))


def stable_hash(values: Column) -> Column:
    """Digest of a map of strings as compact JSON with sorted keys."""
    return digest(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values)))))


def judged_json(text: Column) -> Column:
    """(passed, issues, covered, problem) of the JSON object inside prose; ``problem`` names the first thing that is missing."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(found)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    is_list = lambda path: F.coalesce(kind(path).startswith("ARRAY"), F.lit(False))
    problem = F.when((F.coalesce(found, F.lit("")) == "") | v.isNull(), "no_object").when(~F.coalesce(kind("$.passed") == "BOOLEAN", F.lit(False)), "no_passed").when(~is_list("$.issues"), "no_issues").when(~is_list("$.covered_obligations"), "no_covered")
    return F.struct(F.try_variant_get(v, "$.passed", "boolean").alias("passed"), F.try_variant_get(v, "$.issues", "array<string>").alias("issues"), F.try_variant_get(v, "$.covered_obligations", "array<string>").alias("covered"), problem.alias("problem"))


def expand_id(seed: Column, method: Column, index: Column) -> Column:
    return F.concat_ws("::", seed, method, F.concat(F.lit("v"), index.cast("string")))


def renamed_imports(path: Column, source: Column, names: dict[str, str]) -> Column:
    """Python files with old names replaced by new ones, in the order given; other files as they are."""
    out = source
    for old, new in names.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.when(path.endswith(".py"), out).otherwise(source)
