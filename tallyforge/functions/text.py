"""Text and source-code columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of normalised source: names, sized literals, numbers, single signs (fixed value).
TOKEN = r"(?U)[a-z_]\w*|\d+'[bdho][0-9a-f_xz]+|\d+|\S"
#: Comments; what looks like the start of one inside another is none.
COMMENT = r"(?s)//[^\n]*|/\*.*?\*/"


def normalised(text: Column) -> Column:
    """Comments dropped, lower case, tokens joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(F.regexp_replace(text, COMMENT, " ")), F.lit(TOKEN), F.lit(0)), " ")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: bound as the variable of a lambda, it is not made again wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def ngrams(tokens: Column, n: int = 5) -> Column:
    """Distinct runs of ``n`` tokens; fewer tokens give none."""

    def runs(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(t, i + 1, n), " ")))

    return bound(tokens, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; two empty sets are equal, one empty set is unlike any other."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def strip_think(text: Column) -> Column:
    """Without closed reasoning blocks, and without what precedes a lone closing tag."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?s)^.*</think>", ""))


def think_state(text: Column) -> Column:
    """Whether reasoning and answer tags are closed."""
    return F.when(text.contains("<think>") & ~text.contains("</think>"), "open_think").when(text.contains("<answer>") & ~text.contains("</answer>"), "open_answer").otherwise("ok")


def fenced(text: Column, languages: str = "[a-zA-Z]*") -> Column:
    """Bodies of all fenced blocks, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)```(?:{languages})[ ]*\n(.*?)```"), F.lit(1))


def last_fenced(text: Column) -> Column:
    blocks = fenced(text)
    return F.try_element_at(blocks, F.lit(-1))


def largest(blocks: Column) -> Column:
    """The longest element; the first of equally long ones."""
    return F.reduce(blocks, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def modules(text: Column) -> Column:
    """Complete hardware modules of a text."""
    return F.regexp_extract_all(text, F.lit(r"(?s)\bmodule\b.*?\bendmodule\b"), F.lit(0))


#: Words that a port cannot be named (fixed value).
KEYWORDS = "always and assign begin case else end endmodule for if inout input module not or output reg wire xor".split()
#: How a port is declared (fixed value).
_DECLARED = r"(?i)\b(input|output|inout)\b\s*(?:wire|reg|logic)?\s*(?:signed\b|unsigned\b)?\s*(?:\[\s*([^:\]]+)\s*:\s*([^\]]+)\s*\])?\s*([A-Za-z_]\w*)"


def port_list(source: Column) -> Column:
    """Declared ports as (direction, name, width) in order, each name once; those of the first module's header where there is one.

    The width is 1 or the expression (msb)-(lsb)+1 as written.
    """
    header = F.regexp_extract(source, r"(?is)\bmodule\s+[A-Za-z_]\w*\s*\((.*?)\)\s*;", 1)
    width = lambda p: F.when(F.coalesce(p["msb"], F.lit("")) == "", "1").otherwise(F.concat(F.lit("("), p["msb"], F.lit(")-("), p["lsb"], F.lit(")+1")))

    def declared(within: Column) -> Column:
        part = lambda i: F.regexp_extract_all(within, F.lit(_DECLARED), F.lit(i))
        found = F.arrays_zip(part(1).alias("d"), part(2).alias("msb"), part(3).alias("lsb"), part(4).alias("n"))
        return F.filter(found, lambda p: ~F.lower(p["n"]).isin(*KEYWORDS))

    def once(named: Column) -> Column:
        own = bound(F.transform(named, lambda p: p["n"]), lambda names: F.filter(named, lambda p, i: F.array_position(names, p["n"]) == i + 1))
        return F.transform(own, lambda p: F.struct(F.lower(p["d"]).alias("direction"), p["n"].alias("name"), width(p).alias("width")))

    return bound(bound(bound(header, lambda h: F.when(h == "", source).otherwise(h)), declared), once)


def ports(source: Column) -> Column:
    """Declared ports as 'direction width name', in order."""
    return F.transform(port_list(source), lambda p: F.concat_ws(" ", p["direction"], p["width"], p["name"]))


def interface_digest(declared: Column) -> Column:
    """Digest of an ordered port list of direction, name, width."""
    return digest(F.array_join(F.transform(declared, lambda p: F.concat_ws(":", p["direction"], p["name"], p["width"])), "|"))


def signature(parameters: Column) -> Column:
    """Sorted ``key=value`` pairs of a map."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(parameters), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


def merged_map(defaults: Column, own: Column) -> Column:
    """Both maps; where a key is in both, the second one's value."""
    rest = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(rest, own)


def task_key(name: Column) -> Column:
    """File-safe form of a name with 16 digits of its digest."""
    return F.concat_ws("-", F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_"), F.substring(digest(name), 1, 16))


def hash64_mod(text: Column, n: int) -> Column:
    """First 64 bits of the SHA-256 digest modulo ``n``, exactly (the prefix exceeds a signed long)."""
    return (F.conv(F.substring(digest(text), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(n).cast("decimal(20,0)")).cast("long")


def hash64_mod_by(text: Column, n: Column) -> Column:
    """As :func:`hash64_mod` with a column of small numbers."""
    return (F.conv(F.substring(digest(text), 1, 16), 16, 10).cast("decimal(20,0)") % n.cast("decimal(10,0)")).cast("long")


def hash32_mod(text: Column, n: int) -> Column:
    """First 32 bits of the MD5 digest modulo ``n``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def normalised_transcript(text: Column) -> Column:
    """A transcript without its wall-clock lines."""
    return F.regexp_replace(text, r"(?m)^.*(?:walltime|cpu time|\$finish at).*$\n?", "")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def leaked_identifiers(reference: Column, spec: Column, public: Column) -> Column:
    """Identifiers of a reference, apart from public and short ones, that a specification names."""
    own = F.filter(F.array_distinct(words_of(reference)), lambda w: F.length(w) > 2)
    return F.array_sort(F.array_intersect(F.array_except(own, public), F.array_distinct(words_of(spec))))
