"""Text, code and tag expressions. Column -> Column."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grades
from .grades import let

#: White space as a class and as characters, the tags of steps and reviews, and the note that marks a review given too early.
SPACES = r"\t-\r\x1C-\x20\x{85}\p{Z}"
SPACE_CHARS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
STEP, STEP_END, REVIEW, REVIEW_END = "<step>", "</step>", "<review>", "</review>"
NOTE = "premature final review draft retained as a reasoning note, not as the final scored review"
NOTE_BEGINS = "premature final review draft retained"
#: Marks of code, beginnings of prose.
CODE_MARKERS = (
    "def ", "class ", "import ", "from ", "#include", "int main", "public ", "private ", "function ", "return ", "const ", "let ", "var ", "=>",
    "std::", "System.out",
)
PROSE_PREFIXES = (
    "an effective method", "the function", "to solve ", "the correct approach", "here's how", "we need to", "this solution", "the implementation",
    "the proposed solution", "the solution provided", "writing a ",
)
#: Words that name concrete evidence of a defect.
EVIDENCE_MARKERS = (
    "fails", "incorrect", "wrong", "exception", "runtime error", "syntax error", "does not", "missing", "mismatch", "counterexample", "test",
    "expected", "actual",
)
#: The wording of instructions, tests and prompts.
TRUNCATED = "\n... [truncated]"
NO_TESTS = "No tests are available."
HIDDEN_TESTS = "No tests are available to the reviewer."
INSTRUCTION = (
    "Scoring target: assess candidate code correctness and assign the overall AXIOM code grade.\n\n",
    "Assess functional correctness using concrete evidence from the task, code, and any reviewer-visible tests.",
)
CODE_CUT = (
    "\n\nPrompt-budget note: the candidate code was shortened for evaluation input length. Do not treat the shortening itself as evidence of a syntax "
    "error, missing implementation, or truncated user code; score only the visible code and task evidence."
)
PROBLEM_CUT = "\nPrompt-budget note: the task description was shortened; do not treat omitted text as a code defect."
SCORE_INSTRUCTION = (
    "Score the candidate code using the AXIOM 0-5 ordinal code-quality scale.\nThe scalar score is derived from the AXIOM grade: grade / 5 * 100.\n"
    "Textual review is auxiliary; the primary target is the stable scalar grade.\n\n"
)
REVIEW_QUESTION = "Review the candidate code against the original task. Keep the reasoning grounded in the task requirements and the observed code behavior.\n\nProblem:\n"
#: The evidence of canonical reviews, by functional correctness, by grade, and for exact labels.
FUNCTIONAL_EVIDENCE = {
    True: "The implementation is treated as functionally correct under the AXIOM rubric.",
    False: "The implementation is treated as functionally defective under the AXIOM rubric.",
}
EFFORT_EVIDENCE = {
    5: "No repair effort is expected before deployment.",
    4: "Only minor quality cleanup is expected after functional acceptance.",
    3: "Functionality is accepted, but larger refactoring is expected before deployment.",
    2: "A localized functional fix is expected to make the implementation acceptable.",
    1: "Major functional repair is expected before the implementation can be accepted.",
    0: "The implementation is considered mismatched or rewrite-level incorrect.",
}
EXACT_EVIDENCE = "Static baseline item derived from the reference target label rather than model-generated reasoning."


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{SPACES}]+$", "")


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(SPACE_CHARS))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def after_first(c: Column, mark: str) -> Column:
    return F.when(c.contains(mark), F.substring(c, F.instr(c, mark) + len(mark), F.length(c))).otherwise(c)


def before_first(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def braces(c: Column) -> Column:
    """From the first { to the last }; the whole text if it has no such pair of characters."""
    first, last = F.instr(c, "{"), F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when(c.contains("{") & c.contains("}"), F.substring(c, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(c)


def payload_text(text: Column, fences: bool = True) -> Column:
    """What should be the JSON of a review: without its tags and, if asked, its code fence, from brace to brace."""
    p = let(strip(_or_empty(text)), lambda t: F.when(t.startswith(REVIEW), lstrip(F.substring(t, F.lit(len(REVIEW) + 1), F.length(t)))).otherwise(t))
    p = let(p, lambda t: F.when(t.endswith(REVIEW_END), rstrip(F.substring(t, F.lit(1), F.length(t) - len(REVIEW_END)))).otherwise(t))
    if fences:
        opened = lambda t: F.when(t.contains("\n"), after_first(t, "\n")).otherwise(F.regexp_replace(t, "^`+|`+$", ""))
        closed = lambda t: F.when(t.endswith("```"), rstrip(F.substring(t, F.lit(1), F.length(t) - 3))).otherwise(t)
        p = let(p, lambda t: F.when(t.startswith("```"), let(opened(t), closed)).otherwise(t))
    return let(p, braces)


def review_payload(text: Column, fences: bool = True) -> Column:
    """The JSON object of a review; null if it can't be parsed (an object whose keys repeat counts as such) or is no object."""
    return let(payload_text(text, fences), lambda p: F.when(F.try_parse_json(p).isNotNull() & lstrip(p).startswith("{"), p))


def _true(raw: Column) -> Column:
    return F.coalesce(~raw.isin("false", "", "0", "0.0", "[]", "{}"), F.lit(False))


def truthy(json: Column, path: str) -> Column:
    """Whether the JSON value at a path is neither missing, null, false, zero nor empty."""
    return _true(F.get_json_object(json, path))


#: Fixed value: what a signature takes from a payload.
MEANING = ("verdict", "functional_correctness", "repair_effort", "evidence_type")


def signature(grade: Column, payload: Column) -> Column:
    """What makes two reviews the same in meaning: grade, verdict, functional correctness, effort, evidence type; null without a grade."""
    return let(F.struct(grade.alias("g"), payload.alias("p")), lambda x: raw_signature(x["g"], *[F.get_json_object(x["p"], f"$.{key}") for key in MEANING]))


def raw_signature(grade: Column, *raw: Column) -> Column:
    """As `signature`, of the texts that MEANING has in the payload."""
    low = {key: F.lower(strip(_or_empty(x))).alias(key) for key, x in zip(MEANING, raw, strict=True)}
    return F.when(grade.isNotNull(), F.struct(grade.alias("grade"), low["verdict"], _true(raw[1]).alias("functional"), low["repair_effort"], low["evidence_type"]))


def review_signature(text: Column) -> Column:
    return let(review_payload(text), lambda p: signature(grades.grade_from_payload(p), p))


def similarity_key(text: Column) -> Column:
    """Lower-cased words without the note and the tags, for comparing steps."""
    low = F.regexp_replace(F.replace(F.lower(_or_empty(text)), F.lit(NOTE), F.lit(" ")), r"</?(step|review)>", " ")
    return F.trim(F.regexp_replace(low, r"[^a-z0-9_]+", " "))


def _closed(t: Column) -> Column:
    return F.concat(t, F.lit(f"\n{STEP_END}"))


def normalize_segment(text: Column) -> Column:
    """A response's segment in its tags: the first review's body, else a step, closed if it wasn't. Blank text is null."""

    def made(t: Column) -> Column:
        review = F.concat(F.lit(f"{REVIEW}\n"), strip(before_first(after_first(t, REVIEW), REVIEW_END)), F.lit(f"\n{REVIEW_END}"))
        step = F.when(t.endswith(STEP_END), t).otherwise(_closed(t))
        return F.when(t == "", None).when(t.contains(REVIEW), review).when(t.startswith(STEP), step).otherwise(_closed(F.concat(F.lit(f"{STEP}\n"), t)))

    return let(strip(_or_empty(text)), made)


def close_review(text: Column) -> Column:
    return F.when(text.contains(REVIEW) & ~text.contains(REVIEW_END), F.concat(rstrip(text), F.lit(f"\n{REVIEW_END}"))).otherwise(text)


def step_text(text: Column) -> Column:
    """A rollout's step in its tags; what follows a review's beginning, or a step's end, is dropped."""
    cut = let(strip(text), lambda t: F.when(t.contains(REVIEW), strip(before_first(t, REVIEW))).otherwise(t))

    def made(t: Column) -> Column:
        bare = F.when(t.contains(STEP_END), strip(before_first(t, STEP_END))).otherwise(t)
        return F.when(t.startswith(STEP) & ~t.contains(STEP_END), _closed(t)).when(t.startswith(STEP), t).otherwise(_closed(F.concat(F.lit(f"{STEP}\n"), bare)))

    return let(cut, made)


def unwrap_review(text: Column) -> Column:
    """A generated step or review as (text, action, final_answer)."""
    t = let(strip(text), lambda x: F.when(x.startswith(STEP), lstrip(F.substring(x, F.lit(len(STEP) + 1), F.length(x)))).otherwise(x))
    t = let(t, lambda x: strip(F.when(x.endswith(STEP_END), F.substring(x, F.lit(1), F.length(x) - len(STEP_END))).otherwise(x)))

    def parts(x: Column) -> Column:
        final = x.contains(REVIEW)
        return F.struct(x.alias("text"), F.when(final, "").otherwise(x).alias("action"), F.when(final, strip(after_first(x, REVIEW))).otherwise("").alias("final_answer"))

    return let(t, parts)


def unwrap_code(text: Column, last: bool = False) -> Column:
    """Generated text with a solution in <code> tags, the first or the last, as (text, action, final_answer)."""

    def parts(x: Column) -> Column:
        body = F.substring_index(x, "<code>", -1) if last else before_first(after_first(x, "<code>"), "<code>")
        final = x.contains("<code>")
        whole = F.when(final, F.concat(x, F.lit("\n</step>\n"))).otherwise(x)
        return F.struct(whole.alias("text"), F.when(final, "").otherwise(x).alias("action"), F.when(final, before_first(body, "</code>")).otherwise("").alias("final_answer"))

    return let(text, parts)


def premature_review(text: Column) -> Column:
    """A review that came too early, kept as a step."""
    t = let(strip(text), lambda x: F.when(x.contains(REVIEW), strip(after_first(x, REVIEW))).otherwise(x))
    t = let(t, lambda x: F.when(x.contains(REVIEW_END), strip(before_first(x, REVIEW_END))).otherwise(x))
    return F.concat(F.lit(f"{STEP}\n{NOTE[0].upper()}{NOTE[1:]}:\n"), t, F.lit(f"\n{STEP_END}"))


def truncate(text: Column, most: int, mark: str = TRUNCATED, zero_keeps_all: bool = True) -> tuple[Column, Column]:
    """(stripped text, whether it was cut). most <= 0 keeps all, unless zero_keeps_all is false."""
    t = strip(_or_empty(text))
    if most <= 0 and zero_keeps_all:
        return t, F.lit(False)
    cut = F.length(t) > most
    return F.when(cut, F.concat(rstrip(F.left(t, F.lit(max(0, most)))), F.lit(mark))).otherwise(t), cut


def elide_middle(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most // 2)), F.lit(mark), F.right(text, F.lit(most - most // 2)))).otherwise(text)


def code_block(text: Column) -> Column:
    """The first fenced block's body; a text that only begins with a fence loses that line and a last one that is a fence."""
    pattern = r"(?s)```[a-zA-Z0-9_+-]*\s*\n(.*?)```"

    def body(t: Column) -> Column:
        begun = strip(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*(\n|$)", ""), rf"(^|\n)[{SPACES}]*```[^\n]*$", ""))
        return F.when(F.regexp_like(t, F.lit(pattern)), strip(F.regexp_extract(t, pattern, 1))).when(t.startswith("```"), begun).otherwise(t)

    return let(strip(_or_empty(text)), body)


def python_block(text: Column) -> Column:
    """The first block of a language fence, else of any fence, to the next fence."""
    inside = lambda t, mark: strip(before_first(after_first(t, mark), "```"))
    return let(strip(_or_empty(text)), lambda t: F.when(t.contains("```python"), inside(t, "```python")).when(t.contains("```"), inside(t, "```")).otherwise(t))


def code_blocks(text: Column) -> Column:
    """All blocks with a language, stripped, each with a line break."""
    found = F.regexp_extract_all(text, F.lit(r"```\w+\n([\s\S]*?)```"), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.concat(strip(x), F.lit("\n"))), "")


def _any(test, marks: tuple[str, ...]) -> Column:  # noqa: ANN001
    out = test(marks[0])
    for m in marks[1:]:
        out = out | test(m)
    return out


def looks_like_code(text: Column) -> Column:
    prose = lambda code: let(F.lower(code), lambda low: _any(low.startswith, PROSE_PREFIXES))
    return let(code_block(text), lambda code: (F.length(code) >= 12) & _any(code.contains, CODE_MARKERS) & ~prose(code))


def concrete_evidence(text: Column) -> Column:
    return let(F.lower(_or_empty(text)), lambda low: _any(low.contains, EVIDENCE_MARKERS))


def format_tests(tests: Column, most: int = 5) -> Column:
    shown = F.array_join(F.slice(tests, 1, most), "\n", "None")
    more = F.concat(shown, F.lit("\n... ("), (F.size(tests) - most).cast("string"), F.lit(" more assertions omitted)"))
    return F.when(tests.isNull() | (F.size(tests) == 0), NO_TESTS).when(F.size(tests) > most, more).otherwise(shown)


def assertions(tests: Column) -> Column:
    return F.filter(tests, lambda x: lstrip(x).startswith("assert "))


def task_text(title: Column, content: Column, starter: Column) -> Column:
    body = strip(F.concat(_or_empty(title), F.lit("\n\n"), _or_empty(content)))
    return F.when(_or_empty(starter) != "", F.concat(body, F.lit("\n\nStarter code:\n"), starter)).otherwise(body)


def instruction(problem: Column, code: Column, language: Column, tests: Column, show_tests: bool = False, problem_chars: int = 3500, code_chars: int = 3500, mark_inside: bool = True) -> Column:
    """The instruction of a review. Tests are shown only if asked; cut texts are marked in place, or by notes at the end."""
    task, task_cut = truncate(problem, problem_chars)
    body, body_cut = truncate(code, code_chars, TRUNCATED if mark_inside else "")
    name = strip(_or_empty(language))
    shown = format_tests(tests) if show_tests else F.lit(HIDDEN_TESTS)
    parts = [F.lit(INSTRUCTION[0] + "Task description:\n"), task, F.lit("\n\nCandidate code:\n```"), F.when(name == "", "python").otherwise(name), F.lit("\n"), body, F.lit("\n```\n\nAvailable tests:\n"), shown, F.lit("\n\n" + INSTRUCTION[1])]
    notes = [F.when(task_cut, PROBLEM_CUT).otherwise("")]
    if not mark_inside:
        notes.insert(0, F.when(body_cut, CODE_CUT).otherwise(""))
    return F.concat(*parts, *notes)


def score_instruction(task: Column, code: Column, language: Column, extra: Column | None = None) -> Column:
    """The instruction of a score item; its language is `unknown` where it isn't named."""
    name = F.coalesce(language, F.lit("unknown"))
    more = strip(_or_empty(extra)) if extra is not None else F.lit("")
    added = F.when(more != "", F.concat(F.lit("\n\nAdditional context:\n"), more)).otherwise("")
    return F.concat(
        F.lit(SCORE_INSTRUCTION + "Language: "), name, F.lit("\n\nTask description:\n"), truncate(task, 6000, zero_keeps_all=False)[0], F.lit("\n\nCandidate code:\n```"), F.when(name == "unknown", "").otherwise(name),
        F.lit("\n"), truncate(code_block(code), 10000, zero_keeps_all=False)[0], F.lit("\n```"), added,
    )


def review_question(problem: Column) -> Column:
    return F.concat(F.lit(REVIEW_QUESTION), problem)


def _canonical(grade: int, exact: bool) -> str:
    payload = {"axiom_grade": grade, "score": grade * 20.0, "verdict": grades.VERDICTS[0 if grade >= 4 else 1 if grade == 3 else 2], "functional_correctness": grade >= 3, "repair_effort": grades.REPAIR_EFFORT[grade]}
    means = grades.DESCRIPTIONS[grade]
    if exact:
        payload |= {"evidence_type": "uncertain", "summary": means, "evidence": [f"Use AXIOM grade {grade}: {means}", EXACT_EVIDENCE]}
    else:
        payload |= {"summary": means, "evidence": [FUNCTIONAL_EVIDENCE[grade >= 3], EFFORT_EVIDENCE[grade]]}
    return f"{REVIEW}\n{json.dumps(payload)}\n{REVIEW_END}"


def review_text(grade: Column, exact: bool = False) -> Column:
    """The canonical review of a grade: of a score item, or of an exact label."""
    g = grades.clamp_grade(grade)
    return F.coalesce(*[F.when(g == k, _canonical(k, exact)) for k in range(6)])


def truncate_on_stop(text: Column, stops: list[str]) -> Column:
    """Up to and with the stop sequence that is found first; of two at one place the first listed counts."""
    ends = [F.when(F.instr(text, s) > 0, F.struct(F.instr(text, s).alias("at"), F.lit(k).alias("listed"), F.lit(len(s)).alias("n"))) for k, s in enumerate(stops) if s]
    if not ends:
        return text
    first = F.least(*ends) if len(ends) > 1 else ends[0]
    return F.when(first.isNull(), text).otherwise(F.left(text, first["at"] + first["n"] - 1))


def file_part(value: Column) -> Column:
    """A part of a file name: letters and digits of any script, - and _; others become _."""
    safe = F.regexp_replace(F.regexp_replace(strip(F.coalesce(value.cast("string"), F.lit("unknown"))), r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")
    return F.when(safe == "", "unknown").otherwise(safe)


def fingerprint(*parts: Column, n: int = 64) -> Column:
    return F.left(F.sha2(F.concat(*[p.cast("string") for p in parts]), 256), F.lit(n))


def chunks(values: Column, n: int) -> Column:
    """An array cut into arrays of n, the last with what is left."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(n)))


def lineage(tag: Column) -> Column:
    """The tag's prefixes, root first, itself last."""
    parts = F.split(tag, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def parent_tag(tag: Column) -> Column:
    return F.when(tag.contains("."), F.regexp_replace(tag, r"\.[^.]*$", ""))


def depth(tag: Column) -> Column:
    return F.size(F.split(tag, r"\."))


def descends(tag: Column, ancestor: Column) -> Column:
    return (tag == ancestor) | tag.startswith(F.concat(ancestor, F.lit(".")))


def natural_key(tag: Column) -> Column:
    return F.transform(F.split(tag, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def stage(index: Column, size: Column, segment: Column) -> Column:
    """Where a segment stands in its path: by index (from 0), number of segments and whether it is a review."""
    share = index / F.greatest(size - 1, F.lit(1))
    return F.when(lstrip(segment).startswith(REVIEW), "review").when(size <= 1, "early").when(index == size - 1, "final_step").when(share < 0.34, "early").when(share < 0.67, "middle").otherwise("late")


def pair_role(role: Column) -> Column:
    low = F.lower(_or_empty(role))
    return F.when(low.isin("pos", "positive", "pos_response"), "pos").when(low.isin("neg", "negative", "neg_response"), "neg").otherwise("")


def float_sequence(values: Column, fallback: Column, ignored: float = -100.0) -> Column:
    """values as doubles, as many as fallback has; what is missing or can't be read is taken from there, or is ignored."""
    at = lambda xs, i: grades.number(F.get(xs, i))
    own = F.transform(fallback, lambda x, i: F.coalesce(at(values, i), grades.number(x), F.lit(ignored)))
    return F.when(values.isNotNull(), own).otherwise(F.transform(fallback, lambda x: F.coalesce(grades.number(x), F.lit(ignored))))


def pad(values: Column, size: Column, fill: Column, left: bool = False) -> Column:
    """values with fill up to size, on the right or left."""
    more = F.array_repeat(fill, F.greatest(F.lit(0), size - F.size(values)))
    return F.concat(more, values) if left else F.concat(values, more)


def words(text: Column) -> Column:
    """Number of words: what token_length counts by unless told otherwise."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"([^{SPACES}]+)"), F.lit(1)))


def token_length(prompt: Column, responses: Column, count=words) -> Column:  # noqa: ANN001
    """Tokens of a prompt, of its responses (each stripped, with a line break) and of one end. count: Column -> Column."""
    total = F.aggregate(F.coalesce(responses, F.array().cast("array<string>")), F.lit(0), lambda n, r: n + count(F.concat(strip(r), F.lit("\n"))))
    return count(prompt) + 1 + total


def terminal_error(details: Column, sound: Column | None = None) -> Column:
    """The error named in JSON details; details that can't be parsed are an error themselves, missing ones aren't. sound: whether they can be, if it is known."""
    missing = details.isNull() | (details == "")
    parsed = F.try_parse_json(details).isNotNull() if sound is None else sound
    return F.when(missing, None).when(~parsed, "invalid_reward_details").otherwise(F.get_json_object(details, "$.error"))


def sound_details(details: Column) -> Column:
    """The details if they are a JSON object, else {}."""
    sound = F.try_parse_json(details).isNotNull() & lstrip(details).startswith("{")
    return F.when(F.coalesce(sound, F.lit(False)), details).otherwise("{}")


def quality_issue(responses: Column, repeated: Column) -> Column:
    """Why a path isn't fit for imitation, the first reason that holds; null if it is fit. repeated: whether adjacent steps are near duplicates."""

    def fault(s: Column) -> Column:
        bare = let(strip(s), lambda t: F.when(t.startswith(STEP), lstrip(F.substring(t, F.lit(len(STEP) + 1), F.length(t)))).otherwise(t))
        boxed = bare.startswith("{") | F.lower(s).contains('"axiom_grade"')
        return F.when(F.lower(s).contains(NOTE_BEGINS), "premature_review_step").when(boxed, "json_review_inside_step")

    def ending(p: Column) -> Column:
        kind = F.lower(strip(_or_empty(F.get_json_object(p, "$.evidence_type"))))
        some = F.coalesce(F.exists(F.from_json(F.get_json_object(p, "$.evidence"), "array<string>"), lambda x: strip(x) != ""), F.lit(False))
        empty = p.isNull() | (F.regexp_replace(p, rf"[{SPACES}]", "") == "{}")
        return F.when(empty, "missing_final_review_payload").when(kind.isin("", "none"), "weak_final_evidence_type").when(~some, "empty_final_evidence")

    faults = F.transform(F.filter(responses, lambda s: ~lstrip(s).startswith(REVIEW)), fault)
    first = F.get(F.array_compact(faults), 0)
    last = let(review_payload(F.get(responses, F.size(responses) - 1), fences=False), ending)
    return F.when(responses.isNull() | (F.size(responses) == 0), "empty_response").otherwise(F.coalesce(first, F.when(repeated, "repeated_step"), last))


def modulo_claims(text: Column) -> Column:
    """Claims that `a % b` is or returns c, with whether they hold and the value; the remainder takes the divisor's sign, a zero divisor never holds."""
    pattern = r"(-?\d+\s*%\s*-?\d+)\s*(?:=|==|returns?)\s*(-?\d+(?:\.\d+)?)"
    claims = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def judge(claim: Column) -> Column:
        left, expected = F.regexp_extract(claim, pattern, 1), F.regexp_extract(claim, pattern, 2)
        a, b = (F.regexp_extract(left, r"^(-?\d+)\s*%\s*(-?\d+)$", k).try_cast("double") for k in (1, 2))
        padded = left.rlike(r"(^|\D)0+[1-9]")  # such a number is no literal
        value = a - b * F.floor(F.try_divide(a, b))
        holds = F.coalesce(~padded & (b != 0) & ~expected.rlike(r"^-?0\d+$") & (value == expected.try_cast("double")), F.lit(False))
        actual = F.when(padded, "SyntaxError").when(b == 0, "ZeroDivisionError").otherwise(value.cast("bigint").cast("string"))
        return F.struct(claim.alias("claim"), holds.alias("supported"), actual.alias("actual"))

    return F.transform(claims, judge)
