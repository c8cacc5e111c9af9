"""Problem 4: broken pairs of a prompt and an answer.

A multi-label linear classifier: hashed words and word pairs of every answer,
features of its end and of what it holds, and features of the pair (shared
five-word runs, natural and programming language). It is fitted on all intact
pairs and on copies of them with artificially truncated, copied, swapped,
refused and emptied answers: block by block, each pair in one block, and the
weights of the blocks are averaged. Words, languages and lengths are counted in
all pairs before, thresholds are calibrated on the margins that all pairs and
copies have under a model that was not fitted on them. Whole batches are hashed
at once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import cuts
from tallyforge.llm import languages as spoken_languages
from tallyforge.llm.languages import LABELS, Languages
from tallyforge.llm.linear import BITS, Linear, Rows, fit_logistic, hashed_rows, threshold
from tallyforge.llm.sums import kept, summed, summed_and_kept
from tallyforge.llm.tokens import ANY_WORD, LOWER, U, chunks, mix, splitmix, words
from tallyforge.runtime import bounded_rows, checkpointed

DEFECTS = ["empty", "truncated", "refusal", "copy", "wrong_language"]
#: Pairs that are fitted together, a block, and characters of these at most; all pairs are in some block.
BLOCK, BLOCK_SIZE = 8000, 1 << 26
#: Pairs of which all copies are made; where there are more, each gives fewer of them in turn, one at least.
MADE = 2400
#: Answers to which the counts of words are scaled, so that they say the same of a corpus of any size.
VALUES = 8000
#: Bins of margins: the number and the width.
BINS, BIN = 1 << 12, 1 / 64
#: Defective pairs to an intact one for which the thresholds are calibrated.
PRIOR = 0.04
#: Margin, by defect, from which a given pair may have it and is no example of one without it.
DOUBT = np.array([-3.0, -1.0, -1.5, -1.0, -1.0])
#: Consecutive words by which prompt and answer are compared.
RUN = 5

#: Names of languages as prompts ask for them (fixed values).
_NAMES = {"english": "en", "german": "de", "french": "fr", "spanish": "es", "chinese": "zh", "italian": "it", "portuguese": "pt", "englisch": "en", "deutsch": "de", "anglais": "en", "allemand": "de", "français": "fr", "inglés": "en", "alemán": "de", "español": "es", "英文": "en", "英语": "en", "中文": "zh", "德语": "de", "法语": "fr", "西班牙语": "es"}
_ASKED = re.compile(r"(?:explanation|explain|answer|respond|reply|write|describe|comment|erkl\w+|antwort\w*|expli\w+|réponds?\w*|respond\w+)[^.\n]{0,40}?\b(?:in|auf|en)\s+(" + "|".join(x for x in _NAMES if x.isascii() or "ç" in x or "é" in x or "á" in x or "ñ" in x) + r")\b|用(英文|英语|中文|德语|法语|西班牙语)", re.I)
_THINK = re.compile(r"<(think|thought|reasoning)>.*?(?:</\1>|$)", re.S)
_FENCED = re.compile(r"^[ \t]*(?:```|~~~)[ \t]*([\w+#-]*)[^\n]*\n?(.*?)(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)
_TAGS = re.compile(r"</?[a-z][a-z_]*\s*/?>|```\w*|~~~\w*", re.I)
_QUOTED = re.compile(r"\"[^\"\n]{1,400}\"|“[^”\n]{1,400}”|«[^»\n]{1,400}»|„[^“”\n]{1,400}[“”]|^>[^\n]*", re.M)
_LONE = re.compile(r"\s*(?://[^\n]*|/\*(?:(?!\*/).)*\*/|#[^\n]*|--[^\n]*|<!--(?:(?!-->).)*-->)\s*", re.S)
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|^\s*#[^\n]*|^\s*--[^\n]*|\"\"\".*?(?:\"\"\"|\Z)", re.S | re.M)
_INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u00a0]")
_HAN = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]")
#: Code that is not fenced: its first line, and the end of a module.
_BARE = re.compile(r"^[ \t]*(?:`timescale|module\b|import \w|from \w+ import\b|def \w+\(|@\w+|class \w+|library \w+;|entity \w+)", re.M)
_BARE_END = re.compile(r"^[ \t]*endmodule\b[^\n]*$", re.M)

#: Words that only one programming language has (fixed values), with their weight.
SPELLINGS = {
    "verilog": (1, "module endmodule always always_ff always_comb always_latch posedge negedge assign endcase localparam"),
    "vhdl": (2, "architecture entity std_logic std_logic_vector downto rising_edge process library ieee signal"),
    "python": (2, "def import self torch elif numpy tl triton none"),
    "c": (2, "include void printf std __global__ sizeof float int"),
    "script": (2, "function console const let var fn func println"),
}
_FAMILIES = list(SPELLINGS)
_SPELT = sorted((int(h), k, SPELLINGS[f][0]) for k, f in enumerate(_FAMILIES) for h in words([SPELLINGS[f][1].encode()], ANY_WORD).hash)
_SPELT_HASH, _SPELT_FAMILY, _SPELT_WEIGHT = np.array([x[0] for x in _SPELT], U), np.array([x[1] for x in _SPELT]), np.array([x[2] for x in _SPELT], float)


def essence(answer: str | None) -> str:
    """What an answer holds besides reasoning, tags, fences and invisible characters."""
    rest = answer or ""
    if not rest.isascii():
        rest = _INVISIBLE.sub(" ", rest)
    if "<" in rest:
        rest = _TAGS.sub(" ", _THINK.sub(" ", rest))
    elif "```" in rest or "~~~" in rest:
        rest = _TAGS.sub(" ", rest)
    return rest.strip()


def split(answer: str) -> tuple[str, str]:
    """Code and prose of an answer, its reasoning aside."""
    body = _THINK.sub(" ", answer) if "<" in answer else answer
    if "```" in body or "~~~" in body:
        codes, proses, at = [], [], 0
        for m in _FENCED.finditer(body):
            codes.append(m[2])
            proses.append(body[at : m.start()])
            at = m.end()
        code = "\n".join(codes)
        if code:
            return code, "\n".join((*proses, body[at:]))
    if "<" in body:
        body = _TAGS.sub(" ", body)
    start = _BARE.search(body)
    if start is None:
        return "", body
    last = None
    for last in _BARE_END.finditer(body, start.start()):
        pass
    end = last.end() if last else len(body)
    # comments before and behind the code are no explanation
    return body[start.start() : end], _COMMENT.sub(" ", body[: start.start()] + "\n" + body[end:])


def code_languages(codes: list[str]) -> list[str | None]:
    """Programming language of each source code by words that only it has."""
    w = words([c.encode("utf-8", "replace").translate(LOWER) for c in codes], ANY_WORD)
    at = np.minimum(np.searchsorted(_SPELT_HASH, w.hash), len(_SPELT_HASH) - 1)
    hit = np.flatnonzero(_SPELT_HASH[at] == w.hash)
    row = np.repeat(np.arange(len(codes)), np.diff(w.first))[hit]
    k = len(_FAMILIES)
    score = np.bincount(row * k + _SPELT_FAMILY[at[hit]], _SPELT_WEIGHT[at[hit]], len(codes) * k).reshape(-1, k)
    return [_FAMILIES[i] if n >= 2 else None for i, n in zip(score.argmax(axis=1).tolist(), score.max(axis=1).tolist(), strict=True)]


@dataclass
class Spoken:
    """Word hashes of a batch of texts; signs of Chinese and Japanese count as words."""

    hash: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Spoken:
        parts, first, base = [np.zeros(0, U)], [0], 0
        for a, b in chunks(texts, spoken_languages.PART):
            w = words([(t if t.isascii() else _HAN.sub(r" \g<0> ", t)).encode("utf-8", "replace").translate(LOWER) for t in texts[a:b]], ANY_WORD)
            parts.append(w.hash)
            first.extend((w.first[1:] + base).tolist())
            base += len(w.hash)
        return cls(np.concatenate(parts), np.array(first))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every ``k`` consecutive words of one text, and the text."""
        m, row = len(self.hash) - k + 1, self.row()
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.zeros(m, U)
        for i in range(k):
            h = mix(h * U(3) + self.hash[i : i + m])
        inside = row[:m] == row[k - 1 :]
        return h[inside], row[:m][inside]

    def grams(self, longest: int = 2) -> Rows:
        """Distinct hashed words and pairs of every text, of equal weight and unit length together."""
        keys = []
        for k in range(1, longest + 1):
            h, row = self.runs(k)
            keys.append(row << BITS | (splitmix(h, k) >> U(64 - BITS)).astype(np.int64))
        key = np.sort(np.concatenate(keys))
        key = key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))]
        n = np.bincount(key >> BITS, minlength=len(self.first) - 1)
        return Rows((key & ((1 << BITS) - 1)).astype(np.int32), np.concatenate(([0], np.cumsum(n))), np.repeat(GRAMS / np.sqrt(np.maximum(n, 1)), n).astype(np.float32))


#: Length of the vector of an answer's words and pairs together.
GRAMS = 3.0


def shared_runs(answers: Spoken, prompts: Spoken, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of the answer's runs that its prompt has, share of the prompt's that the answer has, and runs of the answer; ``of`` is the prompt of each answer."""
    a, row = answers.runs(RUN)
    p, own = prompts.runs(RUN)
    n = len(answers.first) - 1
    # the runs of a prompt are looked up under each of its answers
    tagged = np.sort(mix(p + splitmix(own.astype(U), 3)))
    asked = mix(a + splitmix(of[row].astype(U), 3))
    at = np.minimum(np.searchsorted(tagged, asked), max(0, len(tagged) - 1))
    hit = tagged[at] == asked if len(tagged) else np.zeros(len(asked), bool)
    size = np.bincount(row, minlength=n)
    both = np.bincount(row, hit, n)
    whole = np.bincount(own, minlength=len(prompts.first) - 1)[of]
    return both / np.maximum(size, 1), both / np.maximum(whole, 1), size


def asked(prompt: str) -> str | None:
    """The language a prompt asks the explanation to be in, if it names one."""
    low = prompt.lower()
    named = _ASKED.findall(prompt) if any(x in low for x in _NAMES) else []
    return _NAMES[(named[-1][0] or named[-1][1]).lower()] if named else None


def family_of(prompt: str) -> str | None:
    """The programming language a prompt names."""
    return "verilog" if re.search(r"verilog", prompt, re.I) else "python" if re.search(r"python", prompt, re.I) else None


@dataclass
class Described:
    """Features of pairs, and what they were made of."""

    pair: Rows  # what the answer holds, and the pair
    signs: Rows  # the same and how the answer ends
    natural: list[str | None]
    want: list[str | None]
    family: list[str | None]
    written: list[str | None]
    opening: list[str]  # first sentence of the answer's prose
    full: list[bool]  # whether the answer holds something
    words: Rows | None = None  # the answer's words and pairs, which are not kept but made again

    @property
    def wording(self) -> Rows:
        """The signs and the answer's words and pairs."""
        return self.signs.beside(self.words)

    def take(self, which: np.ndarray) -> Described:
        """Some rows; without words."""
        lists = ([getattr(self, x)[i] for i in which.tolist()] for x in ("natural", "want", "family", "written", "opening", "full"))
        return Described(self.pair.take(which), self.signs.take(which), *lists)


def opening(prose: str) -> str:
    return re.split(r"(?<=[.\u3002])\s", prose.strip(), maxsplit=1)[0][:200]


def worded(answers: list[str | None]) -> Rows:
    """Words and pairs of what answers hold."""
    return Spoken.of([essence(a) for a in answers]).grams()


#: Defects that the wording tells beside the signs, that the signs tell, and that what the pair is like tells; of the others n-grams would only learn what answers are about.
WORDED, SIGNED, PAIRED = [0, 2], [1], [3, 4]


@dataclass
class PairModel:
    """The labels of one linear classifier; each has weights for the groups of features that can tell its defect."""

    worded: Linear
    signed: Linear
    paired: Linear
    levels: np.ndarray
    languages: Languages
    known: dict[str, tuple[float, float]]
    limits: frozenset[tuple[str, int]]
    #: What one answer counts in ``known``.
    share: float = 1.0

    def describe(self, prompts: list[str | None], answers: list[str | None], families: list[str | None], sources: list[str | None], own: list[bool] | None = None, asks: dict[str, str | None] | None = None, known: list[tuple[str | None, str | None] | None] | None = None, words: bool = True) -> Described:
        """Features of pairs; prompts that are the same text are looked at once.

        ``own`` says which answers were counted in the vocabulary (none by
        default). What is known already is not looked for again: the languages
        that prompts ask for (``asks``), the natural and the programming language of answers (``known``).
        """
        number: dict[str, int] = {}
        of = np.array([number.setdefault(p or "", len(number)) for p in prompts], np.int64)
        texts = list(number)
        want = [asks[t] for t in texts] if asks is not None else [asked(t) or k for t, k in zip(texts, self.languages.languages(texts), strict=True)]
        named = [family_of(t) for t in texts] if any(f is None for f in families) else [None] * len(texts)
        rest = [essence(a) for a in answers]
        known = known or [None] * len(answers)
        new = [i for i, x in enumerate(known) if x is None]
        parts = [split(answers[i] or "") for i in new]
        spoken_rest, spoken_prompt = Spoken.of(rest), Spoken.of(texts)
        inside, covered, runs = shared_runs(spoken_rest, spoken_prompt, of)
        n_words = np.diff(spoken_rest.first)
        natural, written = ([None if x is None else x[k] for x in known] for k in range(2))
        for i, n, w in zip(new, self.languages.languages([_QUOTED.sub(" ", x) for _, x in parts]), code_languages([x for x, _ in parts]) if new else [], strict=True):
            natural[i], written[i] = n, w
        strings, ends, wants, fams = [], [], [], []
        of, n_words, inside, covered, runs = (x.tolist() for x in (of, n_words, inside, covered, runs))
        for i, a in enumerate(answers):
            w, f = want[of[i]], families[i] or named[of[i]]
            wants.append(w)
            fams.append(f)
            r = rest[i]
            solved = written[i] is not None
            out = [f"rest:{min(12, n_words[i])}", f"solved:{solved}", f"lone:{_LONE.fullmatch(r) is not None}", f"size:{min(9, n_words[i].bit_length())}:{solved}"]
            if len(r) <= 40:
                out.append(f"whole:{r.lower()}")
            end: list[str] = []
            if n_words[i]:
                end, _ = cuts.features(a, cuts.near_limit(sources[i], len(a), self.limits), self.known, self.share if own and own[i] else 0)
                copied = bool(inside[i] > 0.8 and runs[i] > 3 and (not solved or inside[i] > 0.97))
                out += [f"inside:{int(inside[i] * 10)}", f"inside>:{bool(inside[i] > 0.8)}:{solved}", f"covered:{int(covered[i] * 4)}", f"same:{r[:1] == texts[of[i]].lstrip()[:1] and r.split() == texts[of[i]].split()}", f"copy:{copied}", f"both:{int(inside[i] * 5)}:{int(covered[i] * 3)}"]
                coded = f"{written[i] == f}" if solved and f else "none"
                # a web page is no explanation
                said = None if r[:5].lower() in ("<!doc", "<html") else natural[i]
                spoken = "none" if said is None or w is None else "copied" if copied else f"{said == w}"
                out += [f"family:{coded}", f"natural:{spoken}", f"languages:{coded}:{spoken}", f"one wrong:{'False' in (coded, spoken)}"]
            strings.append(out)
            ends.append(end)
        begun = [""] * len(answers)
        if own:
            for i, (_, prose) in zip(new, parts, strict=True):
                begun[i] = opening(prose)
        row, feature = hashed_rows(strings)
        end_row, end_feature = hashed_rows(ends)
        pair, signs = Rows.distinct(row, feature, len(answers)), Rows.distinct(np.concatenate((row, end_row)), np.concatenate((feature, end_feature)), len(answers))
        return Described(pair, signs, natural, wants, fams, written, begun, [bool(r) for r in rest], spoken_rest.grams() if words else None)

    def margin(self, pair: Rows, signs: Rows, wording: Rows) -> np.ndarray:
        out = np.empty((len(signs), len(DEFECTS)))
        out[:, WORDED] = self.worded.margin(wording)
        out[:, SIGNED] = self.signed.margin(signs)
        out[:, PAIRED] = self.paired.margin(pair)
        return out

    def described(self, rows: list[tuple], own: bool = False, step: int = 400, asks: dict[str, str | None] | None = None, known: list[tuple[str | None, str | None] | None] | None = None) -> list[Described]:
        """Features of (prompt, answer, family, source) rows, a few at a time, so that little memory is needed."""
        return [self.describe(*(list(c) for c in zip(*rows[i : i + step], strict=True)), own=[True] * step if own else None, asks=asks, known=known and known[i : i + step]) for i in range(0, len(rows), step)]

    def defects(self, prompts: list[str | None], answers: list[str | None], families: list[str | None], sources: list[str | None], own: list[bool] | None = None) -> np.ndarray:
        """Boolean matrix of rows and defects."""
        if not answers:
            return np.zeros((0, len(DEFECTS)), bool)
        return self.judged(self.describe(prompts, answers, families, sources, own))

    def judged(self, found: Described) -> np.ndarray:
        """The same of described pairs."""
        out = self.margin(found.pair, found.signs, found.wording) >= self.levels
        # an empty answer and a refusal have no other defect
        out[out[:, 0], 1:] = False
        out[out[:, 2], 1] = out[out[:, 2], 3] = out[out[:, 2], 4] = False
        return out


#: Wordings of a refusal, by language, with a slot for what is declined (made up here; the classifier generalises by their n-grams).
_REFUSALS = [
    "I'm sorry, but I can't help with {}.", "I am sorry, but I cannot assist with {}.", "Sorry, I can't provide {}.", "I cannot write {}.", "I can't produce {} because it may be used to harm others.", "I won't produce {}.", "I will not write {}.", "I am unable to provide {}.", "I'm not able to share {}.",
    "Unfortunately I must decline to provide {}.", "I have to decline this request.", "I have to pass on this one.", "I'd rather not write {}.", "I would prefer not to produce {}.", "My apologies, {} is something I cannot produce.", "As an AI model I cannot produce {}.", "As a language model, I am not able to write {}.", "It is not possible for me to write {}.",
    "This request falls outside what I am allowed to do.", "This request is against the policy.", "Providing {} would go against my guidelines, so I will stop here.", "We do not support requests for {}.", "No answer will be given for {}; the policy forbids it.", "Regrettably, {} is not available from this assistant.", "I refuse to complete {}.", "That is not something I can do.", "I must refuse.", "Your request cannot be fulfilled.",
    "Es tut mir leid, dabei kann ich nicht helfen.", "Tut mir leid, das kann ich nicht schreiben.", "Diese Anfrage kann ich leider nicht beantworten.", "Ich darf {} nicht bereitstellen.", "Leider muss ich das ablehnen.", "Ich möchte {} lieber nicht schreiben, danke für das Verständnis.", "Désolé, je ne peux pas répondre à cette demande.", "Je suis désolé, je ne peux pas vous aider.", "Je préfère ne pas écrire {}, merci de votre compréhension.", "Je dois refuser cette demande.", "Cette demande dépasse ce que je peux faire.",
    "Lo siento, no puedo ayudar con eso.", "Lamentablemente no puedo escribir {}.", "Debo rechazar esta solicitud.", "Prefiero no escribir {}, gracias por su comprensión.", "Esta petición va más allá de lo permitido.", "抱歉，我无法帮助完成这个请求。", "对不起，我不能提供这个模块。", "这个问题超出了允许的范围，请换一个问题。", "很遗憾，我必须拒绝这个请求。", "我不能编写这段代码，感谢理解。",
]
_WHAT = ["that", "this", "this file", "the module you describe", "the requested unit", "material of this kind", "that design", "code for {}", "{}", "this kernel", "the code"]
_VERBS = ["write", "produce", "provide", "share", "complete", "create", "generate", "give you", "finish"]
_TAILS = ["", "", " If you have a different question, send it.", " Please ask for something else.", " Thank you for understanding.", " The topic may be restricted.", " The content may be used to harm others.", " You could consult the manual of {} instead.", " Is there another task I can take?"]
_EMPTY = ["", " ", "\n\n", "\u200b\u200b", "```\n```", "```verilog\n\n```", "```python\n```", "<answer></answer>", "<answer>\n</answer>", "<think>{}</think>", "<think>{}</think>\n<answer></answer>", "None", "N/A", "n/a", "null", "nil", "-", "--", "...", "\u2026", "TBD", "tbd.", "pending", "TODO", "[no output]", "(empty)", "[empty]", "(no response)", "<no answer>", "no content"]
#: What a lone comment asks for, put together at random (made up here).
_OPEN, _CLOSE = ["// ", "# ", "/* ", "-- ", "<!-- ", "//", "; "], {"/* ": " */", "<!-- ": " -->"}
_DO = ["TODO", "TODO: ", "FIXME: ", "your ", "add ", "insert ", "write ", "put ", "implement ", "complete ", "fill in ", "to be done: "]
_THING = ["", "code here", "the code", "the module here", "solution", "your solution here", "implementation goes here", "this kernel", "the rest", "answer here", "this later", "the function", "logic here"]
_LEADS = ["", "", "", "The task says: ", "Question: ", "Here is the task again:\n\n", "You asked:\n", "As requested: ", "Sure! ", "Task:\n", "Let me repeat the task. "]




def _refusal(rng: np.random.Generator, name: str, filler: str) -> str:
    pick = lambda x: x[int(rng.integers(len(x)))]
    wording = pick(_REFUSALS)
    for v in ("write", "produce", "provide", "share", "complete"):
        if f" {v} " in wording and rng.random() < 0.7:
            wording = wording.replace(f" {v} ", f" {pick(_VERBS)} ")
    wording = re.sub(r"\b(cannot|can't) (?:produce|write)\.", lambda m: f"{m[1]} {pick(_VERBS)}.", wording)
    out = wording.format(pick(_WHAT).format(name)) + pick(_TAILS).format(name)
    if rng.random() < 0.35:
        out += " " + filler
    if rng.random() < 0.1:
        out = f"**{out}**"
    elif rng.random() < 0.1:
        out = f"<answer>{out}</answer>"
    return out.lower() if rng.random() < 0.1 else out.replace("'", "’") if rng.random() < 0.2 else out


def _copied(rng: np.random.Generator, prompt: str) -> str:
    out = prompt
    r = rng.random()
    if r < 0.2:
        out = out.upper()
    elif r < 0.4:
        out = out.lower()
    elif r < 0.6:
        out = re.sub(r"([,;])\s", r"\1\n", out)
    elif r < 0.7:
        out = "> " + out.replace("\n", "\n> ")
    return _LEADS[int(rng.integers(len(_LEADS)))] + out


def _emptied(rng: np.random.Generator, filler: str) -> str:
    pick = lambda x: x[int(rng.integers(len(x)))]
    if rng.random() < 0.6:
        return pick(_EMPTY).replace("{}", filler)
    mark = pick(_OPEN)
    out = mark + (pick(_DO) + pick(_THING)).strip() + _CLOSE.get(mark, "")
    return f"```\n{out}\n```" if rng.random() < 0.2 else out


#: Kinds of copies that a pair may give: two cuts, a copied prompt, a refusal, nothing, and the answers of two other pairs.
COPIES = 7
#: Labels of made pairs: 1 has the defect, 0 has not, -1 is not known and takes no part.
_MADE = {"truncated": [0, 1, 0, 0, 0], "copy": [0, 0, 0, 1, 0], "cut copy": [0, 1, 0, 1, 0], "refusal": [0, -1, 1, 0, -1], "empty": [1, -1, 0, 0, -1]}


#: Arrays that the fit of a block gives, which are added up over the blocks: squared gradients and weights times these, by group; margins of pairs that have a defect and of those that have not.
_GROUPS = {"worded": WORDED, "signed": SIGNED, "paired": PAIRED}
SHAPES = {**{f"{g} {x}": ((1 << BITS) + 1, len(k)) for g, k in _GROUPS.items() for x in ("seen", "weights")}, "margins": (len(DEFECTS), 2, BINS)}


def usable(pair: tuple) -> bool:
    """Whether a pair can be fitted on: it has a prompt, and an answer that holds something."""
    return bool(pair[0] and essence(pair[1]))


def prose_and_code(answers: list[str]) -> tuple[list[str], list[str]]:
    """What the language model is fitted on."""
    parts = [split(a) for a in answers]
    return [_QUOTED.sub(" ", p) for _, p in parts], [c for c, _ in parts]


def blank(languages: Languages, known: dict[str, tuple[float, float]], limits: frozenset[tuple[str, int]], share: float = 1.0) -> PairModel:
    """A model that has no weights yet."""
    nothing = lambda n: Linear(np.zeros((1 << BITS, n), np.float32), np.full(n, -1.0))
    return PairModel(nothing(len(WORDED)), nothing(len(SIGNED)), nothing(len(PAIRED)), np.zeros(len(DEFECTS)), languages, known, limits, share)


def fit(pairs: list[tuple[str | None, str | None, str | None, str | None]], limits: frozenset[tuple[str, int]] = frozenset(), *, most_made: int = MADE, rounds: int = 3, seed: int = 5) -> PairModel:
    """Fit on all of the (prompt, answer, family, source) rows at hand, as one block."""
    pairs = [p for p in pairs if usable(p)]
    proses, codes = prose_and_code([p[1] for p in pairs])
    shell = blank(Languages.fit([*dict.fromkeys(p[0] for p in pairs), *proses], codes), cuts.vocabulary([p[1] for p in pairs]), limits)
    return averaged(shell, fit_block(shell, pairs, len(pairs), most_made=most_made, rounds=rounds, seed=seed)) if pairs else shell


def averaged(shell: PairModel, sums: dict[str, np.ndarray]) -> PairModel:
    """The model whose weights are the mean of those of the blocks, each counting by its squared gradients, so that a block that never met a feature has no say about it; thresholds by the margins of all."""
    out = {}
    for group, labels in _GROUPS.items():
        seen = sums[f"{group} seen"]
        mean = sums[f"{group} weights"] / np.where(seen > 0, seen, 1)
        out[group] = Linear(mean[:-1].astype(np.float32), np.where(seen[-1] > 0, mean[-1], -1.0))
    levels, middle = np.zeros(len(DEFECTS)), (np.arange(BINS) - BINS / 2 + 0.5) * BIN
    for k, (has, has_not) in enumerate(sums["margins"]):
        if has.any():
            weight = np.concatenate((has * PRIOR * max(1, has_not.sum()) / has.sum(), has_not))
            met = weight > 0
            levels[k] = threshold(np.tile(middle, 2)[met], np.repeat([1, 0], BINS)[met], weight[met])
    return PairModel(**out, levels=levels, languages=shell.languages, known=shell.known, limits=shell.limits, share=shell.share)


def fit_block(shell: PairModel, pairs: list[tuple[str, str, str | None, str | None]], total: int, base: list[Described] | None = None, *, most_made: int = MADE, rounds: int = 3, seed: int | tuple[int, ...] = 5) -> dict[str, np.ndarray]:
    """Fit on a block of usable rows that are mostly intact; the arrays of SHAPES.

    Every row takes part as it is and gives defective copies: all of them
    while ``total``, the rows of all blocks, is not above ``most_made``, else
    fewer in turn, one at least. What one round finds defective among the given
    rows is left out of the next, for that defect only. Margins for the
    thresholds are those of rows under a model of the other half. Where there
    are several blocks, their weights are those of the halves, every row gives
    a refusal besides and every other one an empty answer, and fewer epochs do.
    ``base`` are the rows as the shell describes them, if that was done before.
    """
    rng = np.random.default_rng(seed)
    parts_base = shell.described(pairs, own=True) if base is None else base
    at = 0
    for p in parts_base:
        if p.words is None:
            p.words = worded([x[1] for x in pairs[at : at + len(p.signs)]])
        at += len(p.signs)
    natural, want, family_asked, written, openings = ([x for p in parts_base for x in getattr(p, name)] for name in ("natural", "want", "family", "written", "opening"))
    named = {p: m[0] if (m := re.search(r"\b[a-z]+_[a-z]+_?\w*", p)) else "it" for p in dict.fromkeys(p[0] for p in pairs)}
    names = [named[p[0]] for p in pairs]
    made, label, of, shown = [], [], [], []
    at_limit = dict(shell.limits)
    several = total > len(pairs)
    copies = min(COPIES, max(1.0, COPIES * most_made / max(1, total)))
    turn = rng.permutation(len(pairs)).tolist()
    for i in range(len(pairs)):
        due = {(turn[i] + t) % COPIES for t in range(int(copies) + (rng.random() < copies % 1))}
        prompt, answer, family, source = pairs[i]
        j = int(rng.integers(len(pairs)))
        filler = openings[j]
        new: list[tuple[str, int, list[int]]] = []  # an answer, the pair it was made from or -1, its labels
        for _ in due & {0, 3}:
            short = cuts.cut(answer, rng)
            # some made cuts end at a limit of their source
            if short:
                n = at_limit.get(source)
                short = short[:n] if n and len(short) > n else short
                new.append((short, i, _MADE["truncated" if essence(short) else "empty"]))
        if 1 in due:
            copy = _copied(rng, prompt)
            ended = cuts.cut(copy, rng, trace=False) if rng.random() < 0.3 else None
            new.append((ended or copy, -1, _MADE["cut copy" if ended else "copy"]))
        # these are short, so every pair gives them
        if 4 in due or several:
            new.append((_refusal(rng, names[i], filler), -1, _MADE["refusal"]))
        if 6 in due or several and turn[i] % 2:
            new.append((_emptied(rng, filler), -1, _MADE["empty"]))
        # the answer of another pair, once in a language that is asked for here and once in one that is not, so that it is the pair that tells
        for wrong in [w for w, place in ((False, 2), (True, 5)) if place in due]:
            j = next((int(j) for j in rng.integers(len(pairs), size=40) if bool(want[i] and natural[j] and natural[j] != want[i] or family_asked[i] and written[j] and written[j] != family_asked[i]) == wrong and (natural[j] or written[j])), None)
            if j is not None:
                new.append((pairs[j][1], j, [0, -1, 0, 0, int(wrong)]))
        for text, j, y in new:
            made.append((prompt, text, family, source))
            label.append(y)
            of.append(i)
            shown.append(j)
    of, label, shown = np.array(of, np.int64), np.array(label, np.int64).reshape(-1, len(DEFECTS)), np.array(shown, np.int64)
    # answers of other pairs are as they were found there
    seen_before = [(natural[j], written[j]) if j >= 0 and made[k][1] is pairs[j][1] else None for k, j in enumerate(shown.tolist())]
    every = parts_base + shell.described(made, asks={p[0]: w for p, w in zip(pairs, want, strict=True)}, known=seen_before)
    pair, signs, wording = (Rows.joined([getattr(p, name) for p in every]) for name in ("pair", "signs", "wording"))
    del every, parts_base
    origin = np.concatenate((np.arange(len(pairs)), of))
    # what the given pairs may have unseen is not known of them, nor of what is made of their answers
    doubt = np.zeros((len(pairs), len(DEFECTS)), bool)
    doubt[:, 1] = [(p[3], len(p[1])) in shell.limits for p in pairs]

    def targets() -> np.ndarray:
        own = np.where(doubt, -1, 0)
        made_of = np.where((shown >= 0)[:, None], doubt[shown], False)
        return np.concatenate((own, np.where(made_of & (label == 0), -1, label)))

    begun: dict[tuple[str, bool], dict] = {}

    def fitted(target: np.ndarray, side: bool | None, epochs: int) -> PairModel:
        y, known = np.maximum(target, 0), (target >= 0).astype(float)
        which = np.arange(len(origin)) if side is None else np.flatnonzero((half == side)[origin])
        one = lambda group, rows, labels: fit_logistic(rows, y[:, labels], known[:, labels], epochs=epochs, among=which, keep=True, begun=None if side is None else begun.setdefault((group, side), {}))
        return PairModel(one("worded", wording, WORDED), one("signed", signs, SIGNED), one("paired", pair, PAIRED), shell.levels, shell.languages, shell.known, shell.limits)

    margin = lambda model, which: np.concatenate([np.zeros((0, len(DEFECTS))), *(model.margin(pair.take(own), signs.take(own), wording.take(own)) for own in np.array_split(which, 1 + len(which) // 1000))])
    # each half is judged by the other, so that no defective row is learnt as an intact one and then kept; rare endings must
    # be seen to be known as such, so whether a value is cut its own half tells
    half = rng.random(len(pairs)) < 0.5
    for _ in range(rounds - 1):
        found = np.zeros_like(doubt)
        for side in (False, True):
            judge = fitted(targets(), side, 2 if several else 3)
            own, other = np.flatnonzero(half == side), np.flatnonzero(half != side)
            found[other] |= (margin(judge, other) >= DOUBT) & (np.arange(len(DEFECTS)) != 1)
            found[own, 1] = margin(judge, own)[:, 1] >= DOUBT[1]
        doubt |= found
    target, z, models = targets(), np.empty((len(origin), len(DEFECTS))), []
    for side in (False, True):
        test = np.flatnonzero((half != side)[origin])
        models.append(fitted(target, side, 5 if several else 8))
        z[test] = margin(models[-1], test)
    if not several:
        models = [fitted(target, None, 8)]
    out = {name: np.zeros(shape) for name, shape in SHAPES.items()}
    for m in models:
        for group in _GROUPS:
            one = getattr(m, group)
            seen = np.vstack((one.seen, one.bias_seen)) * (np.vstack((one.weights, one.bias)) != 0)
            out[f"{group} seen"] += seen
            out[f"{group} weights"] += seen * np.vstack((one.weights, one.bias))
    place = np.clip((z / BIN + BINS / 2).astype(np.int64), 0, BINS - 1)
    for k in range(len(DEFECTS)):
        for side, value in enumerate((1, 0)):
            out["margins"][k, side] = np.bincount(place[target[:, k] == value, k], minlength=BINS)
    return out


def sampled(df: DataFrame, intact: str, total: int, n: int) -> DataFrame:
    """About ``n`` of the ``total`` rows that meet a condition, by a hash of the key; the same rows whatever the partitioning."""
    share = int(min(1.0, n / max(1, total)) * (1 << 20)) + 1
    return df.where(intact).where("length(trim(answer)) > 0").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share)


def counted_words(answers: DataFrame) -> DataFrame:
    """(word, n, closes): how often every word is seen in the column ``answer``, and how often it closes a sentence or a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = cuts.counted_words(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([n for _, n in found.values()], pa.int64())], names=["word", "n", "closes"])

    return answers.select("answer").mapInArrow(run, "word string, n long, closes long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("closes").alias("closes"))


def fit_languages(prompts: DataFrame, answers: DataFrame) -> Languages:
    """The language model of all prompts and of the prose and code of all answers."""
    texts = prompts.where("length(trim(prompt)) > 0").select(F.lit(False).alias("answered"), F.col("prompt").alias("text")).unionAll(answers.select(F.lit(True), "answer"))

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
        for b in batches:
            answered, text = (c.to_pylist() for c in b.columns)
            for lo, hi in chunks(text):
                part = list(zip(answered[lo:hi], text[lo:hi], strict=True))
                proses, codes = prose_and_code([t for x, t in part if x])
                yield [t for x, t in part if not x] + proses, codes

    def first_work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], list[str]]]:
        for proses, codes in parted(batches):
            yield spoken_languages.seeded(proses, codes), proses

    def over(one: Callable[[list[str]], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
            total = np.zeros(shape)
            for proses in kept(batches):
                total += one(proses)
            return {"n": total}

        return summed(proses, work, {"n": shape})["n"]

    grams = 1 << spoken_languages.BITS
    # what is prose is found once and kept for the passes that follow
    first, proses = summed_and_kept(texts, first_work, {"grams": (grams, len(LABELS) + 1), "segments": (len(LABELS) + 1,)})
    model = Languages.started(first)
    if len(model.names) == 1:
        return model
    send = prompts.sparkSession.sparkContext.broadcast
    shared = send(model)
    model = model.refined(first, over(lambda proses: shared.value.relabelled(proses), (grams, len(model.names) - 1)))
    fine = send(model)
    return model.bounded(over(lambda proses: fine.value.deviations(proses), (len(model.names), spoken_languages.BINS)))


def blank_pairs(prompts: DataFrame, answers: DataFrame, limits: frozenset[tuple[str, int]], total: int) -> PairModel:
    """The model without weights: words, lengths and languages as they are in all rows of ``answers``, ``total`` in number."""
    words = counted_words(answers)
    share = min(1.0, VALUES / max(1, total))
    frequent = bounded_rows(words.where((F.col("n") > 1) & (F.col("n") * share >= 1)), 4_000_000, "the words met once in VALUES answers")
    return blank(fit_languages(prompts, answers), {r.word: (r.n * share, r.closes * share) for r in frequent}, limits, share)


def fit_pairs(prompts: DataFrame, answers: DataFrame, limits: frozenset[tuple[str, int]], total: int, block: int = BLOCK) -> PairModel:
    """Fit on all (kind, key, prompt_key, answer, source) rows of ``answers``, ``total`` in number, with their prompts."""
    shell = blank_pairs(prompts, answers, limits, total)
    return fit_described(described_pairs(prompts, answers, shell, total, block), shell, total, block) if total else shell


@dataclass
class Held:
    """Pairs of one block and their descriptions."""

    kinds: list[str]
    keys: list[int | None]
    pairs: list[tuple[str | None, str | None, str | None, str]]  # prompt, answer, family, source
    found: Described

    def packed(self) -> tuple[int, bytes]:
        """Size and packed bytes; every prompt once."""
        number: dict[str | None, int] = {}
        of = [number.setdefault(p[0], len(number)) for p in self.pairs]
        raw = pickle.dumps((self.kinds, self.keys, list(number), of, [p[1:] for p in self.pairs], self.found), 5)
        return len(raw), pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def unpacked(cls, packed: bytes, size: int) -> Held:
        kinds, keys, texts, of, rest, found = pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))
        return cls(kinds, keys, [(texts[i], *x) for i, x in zip(of, rest, strict=True)], found)

    def take(self, which: np.ndarray) -> Held:
        some = which.tolist()
        return Held([self.kinds[i] for i in some], [self.keys[i] for i in some], [self.pairs[i] for i in some], self.found.take(which))


#: Pairs that are described and packed together, and their characters at most.
PACK, PACK_SIZE = 400, 1 << 21


def described_pairs(prompts: DataFrame, answers: DataFrame, shell: PairModel, total: int, block: int) -> DataFrame:
    """(block, size, packed): all rows of ``answers`` with their prompts and what they are described by, a few hundred of one block together.

    The fit and the verdicts both read these, so that pairs are described once.
    A prompt and its answers are in one block by a hash of the key, so a
    block is the same whatever the partitioning.
    """
    blocks = max(1, -(-total // block))
    shared = prompts.sparkSession.sparkContext.broadcast(shell)
    number = lambda key: F.pmod(key, F.lit(blocks)).cast("int").alias("block")
    asks = prompts.select(number(F.xxhash64("prompt_key")), "prompt_key", F.lit(0).alias("answered"), F.lit("").alias("kind"), F.lit(None).cast("long").alias("key"), F.col("prompt").alias("text"), F.col("family").alias("word")).where("prompt_key is not null")
    # answers without a prompt are spread over all blocks
    given = answers.withColumn("prompt_key", F.col("prompt_key").cast(prompts.schema["prompt_key"].dataType)).select(number(F.when(F.col("prompt_key").isNull(), F.xxhash64("kind", "key")).otherwise(F.xxhash64("prompt_key"))), "prompt_key", F.lit(1), "kind", "key", "answer", "source")
    rows = asks.unionAll(given).repartitionById(blocks, "block").sortWithinPartitions("block", "prompt_key", "answered", "kind", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shell = shared.value
        held: list[tuple] = []
        size, now = 0, None

        def packed() -> pa.RecordBatch:
            kinds, keys, pairs = ([x[0] for x in held], [x[1] for x in held], [x[2] for x in held])
            found = shell.describe(*(list(c) for c in zip(*pairs, strict=True)), own=[True] * len(held), words=False)
            raw = Held(kinds, keys, pairs, found).packed()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([raw[0]], pa.int64()), pa.array([raw[1]], pa.binary())], names=["block", "size", "packed"])

        last = prompt = family = None
        for at, key, answered, kind, own, text, word in chain.from_iterable(zip(*(b.column(x).to_pylist() for x in ("block", "prompt_key", "answered", "kind", "key", "text", "word")), strict=True) for b in batches):
            if held and (at != now or len(held) >= PACK or size >= PACK_SIZE):
                yield packed()
                held, size = [], 0
            now = at
            if not answered:
                last, prompt, family = key, text, word
            else:
                linked = key is not None and key == last
                held.append((kind, own, (prompt if linked else None, text, family if linked else None, f"{kind}|{word or ''}")))
                size += len(text or "") + len(prompt or "")
        if held:
            yield packed()

    return checkpointed(rows.mapInArrow(run, "block int, size long, packed binary"))


def fit_described(described: DataFrame, shell: PairModel, total: int, block: int) -> PairModel:
    """Fit on the rows of :func:`described_pairs`, block by block.

    A block that got too large, for one prompt has many answers or texts are
    long, is fitted in parts.
    """
    blocks = -(-total // block)
    shared = described.sparkSession.sparkContext.broadcast(shell)

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total_of = {name: np.zeros(shape) for name, shape in SHAPES.items()}
        shell = shared.value
        held: list[Held] = []
        count, size, part, now = 0, 0, 0, None

        def fitted(own: list[Held]) -> None:
            pairs = [p for h in own for p in h.pairs]
            for name, found in fit_block(shell, pairs, total if blocks > 1 or part else len(pairs), [h.found for h in own], seed=(5, now, part)).items():
                total_of[name] += found

        for at, packed in chain.from_iterable(((r["block"], Held.unpacked(r["packed"], r["size"])) for r in b.to_pylist()) for b in batches):
            if at != now:
                if held:
                    fitted(held)
                held, count, size, part, now = [], 0, 0, 0, at
            whole = np.flatnonzero([bool(p[0]) and x for p, x in zip(packed.pairs, packed.found.full, strict=True)])
            if not len(whole):
                continue
            held.append(packed.take(whole))
            count += len(whole)
            size += sum(len(p[0]) + len(p[1]) for p in held[-1].pairs)
            # the rest is at least as large as what is fitted, so that no part is a small one
            if (count >= 2 * block or size >= 2 * BLOCK_SIZE) and len(held) > 1:
                part += 1
                n = max(1, len(held) // 2)
                fitted(held[:n])
                held = held[n:]
                count, size = sum(len(h.pairs) for h in held), sum(len(p[0]) + len(p[1]) for h in held for p in h.pairs)
        if held:
            fitted(held)
        return total_of

    return averaged(shell, summed(described, work, SHAPES))


def defective_pairs(prompts: DataFrame, kinds: dict[str, tuple[DataFrame, str, bool]], *, sample: int | None = None, block: int = BLOCK) -> DataFrame:
    """(pair_kind, pair_key, defect) for every defective pair.

    ``prompts`` has columns prompt_key (unique), prompt and family, the
    programming language asked for, or null to read it from the prompt.
    ``kinds`` maps a kind to a table with columns key, prompt_key, answer and
    source, a condition that most intact pairs meet, and whether sources have
    length limits. Fitted on all pairs that meet the condition, in blocks of
    ``block``; on about ``sample`` of each kind only where that is given. A null or
    blank answer is empty; a null or missing prompt leaves only what the
    answer alone tells; repeated rows are judged each; texts are read whole;
    other columns are ignored; an empty table gives an empty result.
    """
    asks = prompts.select("prompt_key", "prompt", "family")
    limits: set[tuple[str, int]] = set()
    given: list[DataFrame] = []
    every = 0
    for kind, (df, intact, limited) in kinds.items():
        source = F.col("source") if limited else F.lit(None).cast("string")
        lengths = cuts.value_lengths(df.where("length(trim(answer)) > 0").select(F.lit(kind).alias("field"), source.alias("source"), F.col("answer").alias("value"), F.expr(intact).alias("_intact")), "_intact")
        if limited:
            limits |= cuts.length_limits(lengths)
        total = lengths.agg(F.coalesce(F.sum("intact"), F.lit(0))).first()[0]
        rows = df.where(intact).where("length(trim(answer)) > 0") if sample is None else sampled(df, intact, total, sample).orderBy(F.xxhash64("key"), "key").limit(2 * sample + 1000)
        every += total if sample is None else min(total, sample)
        given.append(rows.select(F.lit(kind).alias("kind"), F.col("key").cast("long").alias("key"), "prompt_key", "answer", source.alias("source")))
    answers = reduce(DataFrame.unionByName, given)
    shell = blank_pairs(asks, answers, frozenset(limits), every)
    described = described_pairs(asks, answers, shell, every, block) if every else None
    shared = prompts.sparkSession.sparkContext.broadcast(fit_described(described, shell, every, block) if every else shell)

    def verdicts(found: np.ndarray, kind: list[str], key: list[int | None]) -> pa.RecordBatch:
        row, label = np.nonzero(found)
        return pa.RecordBatch.from_arrays([pa.array([kind[i] for i in row.tolist()], pa.string()), pa.array([key[i] for i in row.tolist()], pa.int64()), pa.array([DEFECTS[j] for j in label.tolist()], pa.string())], names=["pair_kind", "pair_key", "defect"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            kind, key, answer, source, own_word, prompt, family = (c.to_pylist() for c in b.columns)
            for lo, hi in chunks([(x or "") + (y or "") for x, y in zip(answer, prompt, strict=True)]):
                own = slice(lo, hi)
                found = m.defects(prompt[own], answer[own], family[own], [f"{k}|{s or ''}" for k, s in zip(kind[own], source[own], strict=True)], own_word[own])
                yield verdicts(found, kind[own], key[own])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for r in chain.from_iterable(b.to_pylist() for b in batches):
            held = Held.unpacked(r["packed"], r["size"])
            held.found.words = worded([p[1] for p in held.pairs])
            yield verdicts(m.judged(held.found), held.kinds, held.keys)

    # what was described for the fit is judged as it was described, other pairs are described here
    fitted = described is not None and sample is None
    columns = "pair_kind string, pair_key long, defect string"
    parts = []
    for kind, (df, intact, limited) in kinds.items():
        was = F.coalesce(F.expr(intact) & F.expr("length(trim(answer)) > 0"), F.lit(False)) if fitted else F.lit(False)
        own = F.lit(sample is None) & F.coalesce(F.expr(intact), F.lit(False))
        parts.append(df.where(~was).select(F.lit(kind).alias("kind"), F.col("key").cast("long").alias("key"), "prompt_key", "answer", (F.col("source") if limited else F.lit(None).cast("string")).alias("source"), own.alias("counted")))
    paired = reduce(DataFrame.unionByName, parts).join(asks, "prompt_key", "left").select("kind", "key", "answer", "source", "counted", "prompt", "family")
    out = paired.mapInArrow(run, columns)
    return out.unionAll(described.mapInArrow(again, columns)) if fitted else out
