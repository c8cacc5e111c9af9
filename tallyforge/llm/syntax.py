"""Problem 3: source files that do not parse.

A file is lexed into a row of one-letter token classes. Adjacent pairs of
classes are anti-joined with the pairs that the grammar's productions permit;
nesting and productions are then validated by windowed reductions: every
window of classes that is the right side of a production is replaced by its
left side, innermost first, over all files of a batch at once, until nothing
changes. What is left of a valid file is its start symbol. For Python, whose
productions here cover the common statements, the suspects are confirmed by
the interpreter's own parser.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.runtime import checkpointed

#: Token classes of SystemVerilog (fixed values): every word and sign of the language that the productions use.
VERILOG_CLASSES = {
    "module macromodule": "M", "endmodule": "m", "begin": "B", "end": "b", "if": "F", "else": "L", "case casex casez": "C", "endcase": "c", "default": "D",
    "always always_comb always_ff always_latch initial final": "A", "assign deassign force release": "S", "input output inout ref": "I",
    "reg logic wire tri tri0 tri1 triand trior trireg wand wor uwire supply0 supply1 integer int bit byte shortint longint real shortreal realtime time genvar string event var void chandle": "T",
    "signed unsigned": "G", "parameter localparam specparam": "K", "posedge negedge edge": "Z", "or iff": "O", "for": "R", "while repeat wait": "W", "foreach": "R", "forever": "V", "do": "5",
    "generate": "g", "endgenerate": "h", "function": "U", "endfunction": "v", "task": "J", "endtask": "j", "return": "H", "break continue disable": "X", "typedef": "Y", "enum struct union": "N", "packed tagged": "",
    "fork": "1", "join join_any join_none": "2", "assert assume cover": "3", "inside": "4", "and nand nor xor xnor not buf": "a",
    "unique unique0 priority": "", "automatic static const": "",
    "class endclass interface endinterface package endpackage program endprogram property endproperty sequence endsequence clocking endclocking covergroup endgroup primitive endprimitive specify endspecify table endtable config endconfig checker endchecker modport import export extends implements virtual constraint rand randc with expect new null super this extern pure protected local": "!",
    "( )": None, "[ ]": None, "{ }": None, "; , . : # @": None,
    "/ % == != === !== ==? !=? < > >= && || << >> <<< >>> ** -> <->": "o", "*": "*", "+ - & | ^ ~^ ^~": "p", "! ~ ~& ~|": "u", "<=": "l", "=": "e",
    "+= -= *= /= %= &= |= ^= <<= >>= <<<= >>>=": "E", "++ --": "P", "?": "q", "+: -:": "z", "'": "t", "::": "k",
}

_V_TOKEN = re.compile(
    r"""//[^\r\n]*|/\*.*?\*/|"(?:\\.|[^"\\\r\n])*"|`(?:timescale|define|include|default_nettype|line|pragma|undef|ifdef|ifndef|elsif|else|endif|resetall|celldefine|endcelldefine|begin_keywords|end_keywords)\b(?:[^\r\n\\]|\\\r?\n|\\.)*"""
    r"""|`[A-Za-z_]\w*|(?:\d[\d_]*[ \t]*)?'[sS]?(?:[bB][ \t]*[01xXzZ?_]+|[oO][ \t]*[0-7xXzZ?_]+|[dD][ \t]*[\dxXzZ?_]+|[hH][ \t]*[0-9a-fA-FxXzZ?_]+)|'[01xXzZ](?!\w)"""
    r"""|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[fpnum]?s\b)?|[A-Za-z_][\w$]*|\$[A-Za-z_][\w$]*|\\[^\s]+(?=\s)"""
    r"""|<<<=|>>>=|===|!==|==\?|!=\?|<<<|>>>|<<=|>>=|<->|->|<=|>=|==|!=|&&|\|\||<<|>>|\*\*|~\^|\^~|~&|~\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|\+\+|--|\+:|-:|::|[^\s]""",
    re.S,
)


class _Classes(dict):
    """Class of every token seen, found once per spelling."""

    def __init__(self, table: dict[str, str | None]) -> None:
        super().__init__()
        for words, cls in table.items():
            for w in words.split():
                self[w] = w if cls is None else cls
        self.fixed = len(self)

    def __missing__(self, token: str) -> str:
        c = token[0]
        if token.startswith(("//", "/*")) and len(token) > 2 or token.startswith("//"):
            out = "" if not token.startswith("/*") or token.endswith("*/") and len(token) > 3 else "!"
        elif c == "`":
            word = re.match(r"`(\w*)", token)[1]
            out = "!" if not word else "" if word in _DIRECTIVES else "i"
        elif c == '"':
            out = "s" if len(token) > 1 else "!"
        elif c.isdigit() and c.isascii() or c == "'" and len(token) > 1:
            out = "n"
        elif c == "$" and len(token) > 1:
            out = "y"
        elif (c.isalpha() or c == "_") and token.isascii() or c == "\\" and len(token) > 1:
            out = "i"
        else:
            out = "!"
        if len(self) < 400_000 and len(token) < 40:
            self[token] = out
        return out


_DIRECTIVES = frozenset("timescale define include default_nettype line pragma undef ifdef ifndef elsif else endif resetall celldefine endcelldefine begin_keywords end_keywords".split())
_V = _Classes(VERILOG_CLASSES)


#: Attributes may stand before any item, statement, port or argument list; ``or`` starts a gate where an item may begin.
_V_ATTRIBUTE = re.compile(r"\(\*i(?:e[nsi])?(?:,i(?:e[nsi])?)*\*\)(?![;),\]}mbchvj2]|$)")
_V_OR_GATE = re.compile(r"(?<=[;bhvjgBL])O(?=i|\(|#)")


def lex_verilog(text: str) -> str:
    classes = "".join(map(_V.__getitem__, _V_TOKEN.findall(text.removeprefix("﻿"))))
    return _V_OR_GATE.sub("a", _V_ATTRIBUTE.sub("", classes))


_O = "[ixr]"
_DECLARED = f"i(?:e{_O})?(?:,i(?:e{_O})?)*"
#: Productions as windows of classes and the class that replaces them; x is an expression, r a call, Q a statement, & a module item, " a declaration, $ a module.
_V_EXPRESSIONS = [
    (rf"3\({_O}\)", "7"),
    (rf"4\{{(?:{_O}|d|\[{_O}:{_O}\])(?:,(?:{_O}|d|\[{_O}:{_O}\]))*\}}", "ox"),
    (r"[ns](?!\()", "x"),
    (r"y(?![(])", "r"),
    (r"i[.k](?=i)", ""),
    (rf"i\[{_O}(?:[:z]{_O})?\]", "i"),
    (rf"\{{{_O}?\{{{_O}(?:,{_O})*\}}\}}", "x"),
    (rf"(?<!4)\{{i(?:e{_O})?(?:,i(?:e{_O})?)*\}}", "i"),
    (rf"(?<!4)t?\{{{_O}(?::{_O})?(?:,{_O}(?::{_O})?)*\}}", "x"),
    (rf"(?<![iMUJTGdxr#.)])i\((?:{_O}(?:,{_O})*)?\)", "r"),
    (rf"y\((?:{_O}?(?:,{_O}?)*)\)", "r"),
    (rf"[Tix]t\({_O}\)", "x"),
    (rf"(?<![iyMFCRWUJ@#tT3a])\({_O}\)", "x"),
    (rf"(?<![ixr)\]}}])[up]+{_O}(?![\[(.kt])", "x"),
    (rf"{_O}(?:[op*][up]*{_O})+(?![\[(.kt])", "x"),
    (rf"(?<=[(q\[,o&*]){_O}l{_O}(?=[)q:\],op*])", "x"),
    (rf"{_O}q{_O}:{_O}(?![\[(.ktop*q])", "x"),
    (rf"(?<![i\]])\[{_O}(?::{_O})?\]|(?<=[TG])\[\]", "d"),
]
_CTX = r'(?<=[BQfL:~wV"A;157])'
_V_STATEMENTS = [
    (rf"@(?:\*|i|\(\*\)|\(Z?{_O}(?:O{_O})?(?:[O,]Z?{_O})*\))", "~"),
    (rf"#(?:{_O}(?![\[(.])|\({_O}(?:,{_O})*\)(?=[^i(]))", "~"),
    (rf"R\((?:T?d*ie{_O})?;{_O}?;(?:i(?:P|[eE]{_O})|Pi)?\)", "w"),
    (rf"R\(({_O}l{_O}|T?d*ie{_O})", "R("),
    (rf"R\(((?:T?d*ie{_O})?;){_O}l{_O};", r"R(\1x;"),
    (rf"W\({_O}\)", "w"),
    (r"w;", "6"),
    (r"5Q6|[XW]1;|7LQ|7QLQ|7Q(?!L)|1(?::i)?[\"Q]*2(?::i)?", "Q"),
    (r"(?<=[B1])i:(?=7)", ""),
    (rf"a(?:~|#{_O}|#\({_O}(?:,{_O})*\))?(?:r|id?\({_O}(?:,{_O})+\)|\({_O}(?:,{_O})+\))(?:,(?:r|id?\({_O}(?:,{_O})+\)|\({_O}(?:,{_O})+\)))*;", "&"),
    (rf"F\({_O}(?:l{_O})?\)", "f"),
    (rf"C\({_O}\)", "K(" + ")"),
    (rf"{_CTX}(?:i[leE]~?{_O}|r|iP|Pi|H{_O}?|Xi?)?;|(?<=[BfL:~wV])Sie{_O};", "Q"),
    (r"(?:fQL)*fQ(?!L)|(?:fQL)+Q|[~wV]Q", "Q"),
    (r'B(?::i)?"*Q*b(?::i)?', "Q"),
    (rf"(?<=K\(\)|..%)(?:{_O}(?:,{_O})*:|D:?)Q", "%%%"),
    (r"K\(\)(?:%%%)+c", "Q"),
    # a loop over nothing, unless it ends a do
    (r"(?<=[BQfL:~wV\"A17])(?<!5Q)6", "Q"),
    (r"AQ", "&"),
    (r"(?<![BQfL:~wV])S~?(?:ie[ixr])(?:,ie[ixr])*;", "&"),
    (rf"(?<![(,I])(?:T+G?d*|YN?T?G?d*i?d*|N?T?G?d*i)d*{_DECLARED};", '"'),
    (rf"KT?G?d*{_DECLARED}(?:,KT?G?d*{_DECLARED})*;", '"'),
    (rf"IT?G?d*{_DECLARED};", '"'),
    (r'\{"+\}', "i"),
    (rf"\.i\({_O}?\)|\.(?:i|\*)(?=[,)])", "^"),
    (rf"i(?:#\((?:\^(?:,\^)*|{_O}(?:,{_O})*)\))?i\((?:\^(?:,\^)*|{_O}?(?:,{_O}?)*)\)(?:,i\((?:\^(?:,\^)*|{_O}?(?:,{_O}?)*)\))*;", "&"),
    (rf"[UJ]T?G?d*i(?:\((?:I?T?G?d*i(?:e{_O})?(?:,I?T?G?d*i(?:e{_O})?)*)?\))?;[\"Q]*[vj](?::i)?", "&"),
    (r'B(?::i)?[&"]*&[&"]*b(?::i)?', "&"),
    (r"(?:f&L)+&|f&(?!L)|w&", "&"),
    (r'g[&"]*h', "&"),
    (rf"Mi(?:#\((?:K?T?G?d*i(?:e{_O})?(?:,K?T?G?d*i(?:e{_O})?)*)?\))?(?:\((?:(?:IT?G?d*i(?:e{_O})?(?:,I?T?G?d*i(?:e{_O})?)*)|i(?:,i)*)?\)|x|r)?;[&\";]*m(?::i)?", "$"),
]
_V_GOAL = re.compile(r'[$"]*')

#: Classes of Python (fixed values): words and signs that the productions use.
PYTHON_CLASSES = {
    "def": "D", "class": "C", "if": "F", "elif": "E", "while": "h", "else": "L", "try": "y", "finally": "Y", "for": "R", "return": "r", "import": "I", "from": "M", "as": "A", "pass break continue": "p", "raise": "r", "assert": "a", "del global nonlocal": "g", "with": "W", "except": "X",
    "and or": "o", "in": "N", "is": "o", "not": "u", "lambda": "!", "yield await async": "!", "None True False": "x",
    "( )": None, "[ ]": None, "{ }": None, ", : . ; @": None, "=": "=", "+ -": "+", "~": "u", "* **": "*", "/ // % << >> & | ^ < > <= >= == !=": "o", "->": ">", ":=": "o",
    "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=": "q", "...": "x",
}
_P_TOKEN = re.compile(
    r"""#[^\r\n]*|[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|"(?!"")(?:\\(?:\r\n|.)|[^"\\\r\n])*"|'(?!'')(?:\\(?:\r\n|.)|[^'\\\r\n])*')"""
    r"""|\\\r?\n|(?:\r\n|\n|\r)[ \t\f]*|0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[jJ]?|[^\W\d]\w*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|>>|<<|<=|>=|==|!=|[^\s]""",
    re.S,
)


def lex_python(text: str) -> str:
    """Token classes of a Python file; n ends a logical line, J and O are an indent and a dedent."""
    table = _PY
    out: list[str] = []
    indents, depth, fresh = [0], 0, True
    for t in ["\n", *_P_TOKEN.findall(text.removeprefix("﻿")), "\n", None]:
        if t is None:
            out += ["O"] * (len(indents) - 1)
        elif t[0] in "\r\n":
            if depth:
                continue
            if not fresh:
                out.append("n")
            fresh = True
            width = len(t.lstrip("\r\n").expandtabs(8))
        elif t[0] == "#" or t[0] == "\\" and len(t) > 1:
            continue
        else:
            if fresh and not depth:
                if width > indents[-1]:
                    indents.append(width)
                    out.append("J")
                while width < indents[-1]:
                    indents.pop()
                    out.append("O")
                if width != indents[-1]:
                    out.append("!")
                fresh = False
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
            cls = table.get(t)
            if cls is None:
                c = t[0]
                last = t[-1]
                cls = "s" if last in "\"'" and len(t) > 1 else "x" if c.isdigit() or c == "." and len(t) > 1 else "i" if t.isidentifier() else "!"
            out.append(cls)
    return "".join(out)


_PY = {w: (w if c is None else c) for words, c in PYTHON_CLASSES.items() for w in words.split()}
#: i is what can be assigned to, t a bracketed list of values, which may hold such, x any other expression. Only what is common needs a production: the interpreter decides on the rest.
_X = "[ixt]"
#: Named arguments stand behind all others.
_ARGS = rf"(?:\*?{_X}(?:,\*?{_X})*(?:,(?:i=|\*){_X})*|(?:i=|\*){_X}(?:,(?:i=|\*){_X})*)"
_P_EXPRESSIONS = [
    (r"s+", "x"),
    (rf"{_X}\.i", "i"),
    (rf"{_X}\((?:{_ARGS},?)?\)", "x"),
    (rf"(?<=[ixt])\[(?:{_X}?(?::{_X}?)?(?::{_X}?)?)(?:,{_X}?(?::{_X}?)?(?::{_X}?)?)*,?\]", "#"),
    (r"[ixt]#", "i"),
    (rf"(?<![ixtDC)])\((?:\*?{_X}(?:,\*?{_X})*,?)?\)", "t"),
    (rf"(?<![ixt\])}}])\[(?:\*?{_X}(?:,\*?{_X})*,?)?\]", "t"),
    (rf"\{{(?:(?:{_X}:{_X}|\*?{_X})(?:,(?:{_X}:{_X}|\*?{_X}))*,?)?\}}", "x"),
    (rf"(?<![ixt)\]}}])(?:[+u]){_X}(?![.(\[])", "x"),
    (rf"{_X}(?:(?:[o+*N]|uN|ou?)[+u]*{_X})+(?![.(\[])", "x"),
    (rf"{_X}F{_X}L{_X}(?![.(\[o+*N])", "x"),
]
_S = r"(?<![^nJOSB\n])"
_P_STATEMENTS = [
    (rf"{_S}(?:(?:[it](?:,[it])*,?=)*{_X}(?:,{_X})*,?|i:{_X}(?:={_X})?|iq{_X}(?:,{_X})*|r(?:{_X}(?:,{_X})*)?(?:M{_X})?|p|a{_X}(?:,{_X})?|g[it](?:,[it])*|Ii(?:Ai)?(?:,i(?:Ai)?)*|M\.*i?I(?:i(?:Ai)?(?:,i(?:Ai)?)*|t|\*))(?:;(?=[^n]))?n", "S"),
    (r"JS+O", "B"),
    (rf"@{_X}n(?=[@DCS])", ""),
    (rf"Di\((?:\*?\*?i?(?::{_X})?(?:={_X})?(?:,\*?\*?i?(?::{_X})?(?:={_X})?)*,?|{_ARGS})?\)(?:>{_X})?:nB", "S"),
    (rf"D[xt](?:>{_X})?:nB|Ci?[xt]?(?:\((?:{_ARGS})?\))?:nB", "S"),
    (rf"F{_X}:nB(?:E{_X}:nB)*(?:L:nB)?|h{_X}:nB(?:L:nB)?|R{_X}(?:,{_X})*N{_X}(?:,{_X})*:nB(?:L:nB)?|Rx:nB(?:L:nB)?|W{_X}(?:A{_X})?(?:,{_X}(?:A{_X})?)*:nB|y:nB(?:X(?:{_X}(?:Ai)?)?:nB)+(?:L:nB)?(?:Y:nB)?|y:nBY:nB", "S"),
]
_P_GOAL = re.compile(r"S*")


def _pairs(sources: list[str]) -> list[str]:
    """Pairs of classes that the productions let stand next to each other.

    Derived from the grammar: its nonterminals are expanded to what may begin
    and end them, for every two neighbouring symbols of a production.
    """
    out = set()
    for production in sources:
        symbols = production.split()
        for a, b in zip(symbols, symbols[1:], strict=False):
            for x in _ENDS.get(a, a):
                for y in _BEGINS.get(b, b):
                    out.add(x + y)
    return sorted(out)


_OPERAND_BEGIN, _OPERAND_END = "insyup({tTP", "insy)]}P"
_BEGINS = {"EXPR": _OPERAND_BEGIN, "NAME": "i{", "STMT": 'iyBFCRWV;@#HXSPT{NKG135', "ITEM": "ASTKIiUJgFRCYN;#ya", "TYPE": "TGi[N", "BIN": "op*lq", "ID": "i", "ASSIGN": "leE", "DIM": "[", "TOP": "MTKUJYNi"}
_ENDS = {"EXPR": _OPERAND_END, "NAME": "i]})", "STMT": "b;cji2", "ITEM": ";bhvji", "TYPE": "TGi]}", "BIN": "op*lq", "ID": "i", "ASSIGN": "leE", "DIM": "]", "TOP": "m;vji"}
#: The grammar as plain productions, a symbol per word; upper-case words are nonterminals.
VERILOG_PRODUCTIONS = [
    "TOP TOP", "M ID ( I", "ID #", "# (", "( K", "M ID ;", "M ID #", "( )", ") (", "( ID", "ID ,", ", ID", "ID )", ") ;", "; ITEM", "ITEM ITEM", "ITEM m", "; m", "m :", ": ID", "I TYPE", "I ID", "TYPE ID", "TYPE DIM", "TYPE G", "T G", "G DIM", "DIM DIM", "DIM ID", ", I", ", K", ", TYPE", "K TYPE", "K ID",
    "EXPR BIN EXPR", "q EXPR : EXPR", "( EXPR )", "[ EXPR : EXPR ]", "[ EXPR z EXPR ]", "[ EXPR ]", "[ ]", "{ EXPR , EXPR }", "EXPR {", "} }", "u EXPR", "p EXPR", "BIN u", "BIN p", "ID [", "] [", "ID (", "y (", "( ,", ", ,", ", )", "EXPR . ID", "] . ID", "ID k ID", "t (", "t {", "EXPR t", "T t", "{ ID e EXPR , ID", "e t",
    "NAME ASSIGN EXPR ;", "ASSIGN #", "ASSIGN @", "EXPR ;", "ID P ;", "P ID ;", "ID P )", "P ID )", "STMT STMT", "B STMT", "B b", "B :", "STMT b", "b :", "b STMT", "b ITEM", "b L", "; L", "L STMT", "F ( EXPR )", ") STMT", "C ( EXPR )", ") EXPR", ") D", "EXPR : STMT", "EXPR , EXPR :", "D : STMT", "D STMT", "STMT EXPR", "STMT D", "STMT c", "c STMT", "c b", "c L",
    "A STMT", "A @", "@ (", "@ *", "@ ID", "( *", "* )", "( Z EXPR", "( EXPR O EXPR", "EXPR O Z", ", Z", "* STMT", "# EXPR", "EXPR STMT", "R ( T ID", "R ( ID", "; EXPR", "; )", "; P", "W ( EXPR", "V STMT", "H EXPR", "H ;", "X ;", "X ID", "S NAME e EXPR", "S #", ") NAME", ", NAME", "c ITEM", "c m",
    "( .", ", .", ". ID (", ". *", "* ,", ". ID )", ". ID ,", "ID ID", ") ID", "y ;", "y BIN", "y )", "y ,", "g ITEM", "ITEM h", "h ITEM", "h m", "U TYPE", "U ID", "J ID", "; v", "; j", "b v", "b j", "STMT v", "STMT j", "v :", "j :", "v ITEM", "j ITEM", "v m", "j m", "Y TYPE", "Y N", "N {", "N T", "{ T", "; }", "} ID", "B ITEM", "ITEM b", "L ITEM", ") ITEM", ": ITEM", "v TOP", "b m",
    "K T", "T ID", "b c", "b D", "b EXPR", "; D", "; c", "1 STMT", "1 :", "1 2", "STMT 2", "2 STMT", "2 b", "2 :", "2 ITEM", "2 m", "2 L", "X 1", "W 1", "1 ;", "5 STMT", "STMT W", "3 (", ") L", ": 3", "EXPR 4", "4 {", "{ [", ", [", "] ,", "] }", "a ID", "a (", "a #", "A 1", "A 5", "A 3",
]
_P_BEGIN, _P_END = "isx+u([{*.", "isx)]}."
_PYTHON_PAIR_PRODUCTIONS = [
    "EXPR BIN EXPR", "EXPR =", "= EXPR", "EXPR n", "EXPR ,", ", EXPR", ", )", ", ]", ", }", "( )", "[ ]", "{ }", "( EXPR", "EXPR )", "[ EXPR", "EXPR ]", "{ EXPR", "EXPR }", "EXPR (", "EXPR [", "EXPR .", ". i", ". I", "EXPR :", ": EXPR", ": n", ": ]", "[ :", ": :", ": ,", "* EXPR", ", *", "( *", "* ,", "BIN u", "u N", "u EXPR", "+ EXPR", "s s", "EXPR F", "F EXPR", "E EXPR", "h EXPR", "EXPR L", "L EXPR", "L :", "y :", "Y :", "EXPR q", "q EXPR", "EXPR ;", "; STMT",
    "LINE LINE", "n J", "n O", "O O", "J LINE", "O LINE", "O L", "O X", "O E", "O Y", "n L", "n X", "D i", "C i", "i (", "i :", ") :", ") >", "> EXPR", "R EXPR", "EXPR N", "r EXPR", "r n", "r M", "EXPR M", "M EXPR", "p n", "p ;", "a EXPR", "g EXPR", "I EXPR", "I *", "I (", "* n", "M .", "M i", "i I", "i A", "A i", ") A", "A EXPR", "W EXPR", "X EXPR", "X :", "@ EXPR", "n @",
]


def permissible_pairs() -> list[tuple[str, str]]:
    """(language, pair) rows of the anti-join; a few hundred, whatever the data."""
    global _BEGINS, _ENDS
    rows = [("verilog", x) for x in _pairs(VERILOG_PRODUCTIONS)]
    kept = _BEGINS, _ENDS
    line = "isx+u([{*@DCFhyRrIMpagWLX"
    _BEGINS = {"EXPR": _P_BEGIN, "BIN": "o+*N", "LINE": line, "STMT": line}
    _ENDS = {"EXPR": _P_END, "BIN": "o+*Nu", "LINE": "nO"}
    rows += [("python", x) for x in _pairs(_PYTHON_PAIR_PRODUCTIONS)]
    _BEGINS, _ENDS = kept
    return rows


def _reduced(classes: list[str], rules: list[list[tuple[str, str]]]) -> list[str]:
    """Apply each group of productions to all files at once until none of them applies."""
    joined = "\n".join(classes)
    for group in rules:
        compiled = [(re.compile(p), by) for p, by in group]
        active = True
        while active:
            before = len(joined), joined
            for p, by in compiled:
                joined = p.sub(by, joined)
            active = joined != before[1]
    return joined.split("\n")


def unparsed(classes: list[str], language: str) -> list[bool]:
    """Whether the windowed reductions leave something else than the start symbol."""
    if not classes:
        return []
    if language == "verilog":
        return [_V_GOAL.fullmatch(x) is None for x in _reduced(classes, [_V_EXPRESSIONS, _V_EXPRESSIONS + _V_STATEMENTS])]
    return [_P_GOAL.fullmatch(x) is None for x in _reduced(classes, [_P_EXPRESSIONS, _P_EXPRESSIONS + _P_STATEMENTS])]


def python_parses(text: str) -> bool:
    """The interpreter's own verdict on a Python file."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text.removeprefix("﻿"))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


_LEXED = "record_table string, record_key long, repo string, language string, classes string, suspect boolean, text string, file string"


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, done = TaskContext.get().partitionId(), 0
    for b in batches:
        name, key, repo, language, text = (c.to_pylist() for c in b.columns)
        classes = [lex_verilog(t) if lang == "verilog" else lex_python(t) for lang, t in zip(language, text, strict=True)]
        suspect = [False] * len(text)
        for lang in ("verilog", "python"):
            own = [i for i, x in enumerate(language) if x == lang]
            for i, bad in zip(own, unparsed([classes[i] for i in own], lang), strict=True):
                suspect[i] = bad
        # keys may be repeated; what is written once tells the rows apart. Only Python's text is needed again, by the check that follows
        file = [f"{task}-{done + i}" for i in range(len(text))]
        done += len(text)
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(key, pa.int64()), pa.array(repo, pa.string()), pa.array(language, pa.string()), pa.array(classes, pa.string()), pa.array(suspect, pa.bool_()), pa.array([t if x == "python" else None for x, t in zip(language, text, strict=True)], pa.string()), pa.array(file, pa.string())], names=["record_table", "record_key", "repo", "language", "classes", "suspect", "text", "file"])


def source_files(parts: dict[str, tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(record_table, record_key, repo, language, text) of tables given as name: (table, key, path, text, repo)."""
    blank = r"^[\s\u200b\u200c\u200d\u2060\ufeff\u00ad\u00a0\u3000]*$"
    each = []
    for name, (df, key, path, text, repo) in parts.items():
        language = F.when(F.lower(F.col(path)).rlike(r"\.(v|sv|vh|svh)$"), "verilog").when(F.lower(F.col(path)).rlike(r"\.py$"), "python")
        each.append(df.select(F.lit(name).alias("record_table"), F.col(key).cast("long").alias("record_key"), F.col(repo).cast("string").alias("repo"), language.alias("language"), F.col(text).alias("text")).where(F.col("language").isNotNull() & F.col("text").isNotNull() & ~F.col("text").rlike(blank)))
    return reduce(DataFrame.unionByName, each)


def invalid_files(files: DataFrame) -> DataFrame:
    """(record_table, record_key, repo, language) of the files that are not valid in their language.

    ``files`` as of :func:`source_files`: null and blank values and paths of
    other languages are not judged; a file of only comments is valid; files of
    any length are read whole; repeated rows are judged each; an empty table
    gives an empty result.
    """
    spark = files.sparkSession
    lexed = checkpointed(files.mapInArrow(_lex, _LEXED))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("classes") - 1), lambda i: F.substring("classes", i, F.lit(2))))
    rows = lexed.where(~F.col("suspect") & (F.length("classes") > 1)).select("file", "language", F.explode(pairs).alias("pair"))
    permitted = spark.createDataFrame(permissible_pairs(), "language string, pair string")
    odd = rows.join(F.broadcast(permitted), ["language", "pair"], "left_anti").select("file").distinct()
    columns = ["record_table", "record_key", "repo", "language", "text"]
    suspects = lexed.where("suspect").select(*columns).unionByName(lexed.join(odd, "file", "left_semi").select(*columns))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [lang != "python" or not python_parses(t) for lang, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=b.schema.names[:4]).filter(pa.array(bad, pa.bool_()))

    return suspects.mapInArrow(confirm, "record_table string, record_key long, repo string, language string")
