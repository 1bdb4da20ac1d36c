"""Queries on texts, code, payloads and claims."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grades as G
from ..functions import texts as X
from ..functions import udfs
from . import tables as T
from .grade_queries import EFFORTS, VERDICT
from .registry import column, query, quoted, sql_rstrip, sql_strip
from .tables import documents, text_of

C = F.col
NL = "chr(10)"


def boxed() -> Column:
    """A review with its tags, a code fence, or neither; some can't be parsed."""
    body = text_of('{"axiom_grade": ', C("grade"), ', "verdict": " Accept ", "functional_correctness": ', F.when(C("pos") % 2 == 0, "true").otherwise("false"), ', "repair_effort": "NONE"}')
    return F.when(C("pos") % 4 == 0, text_of(" <review>\n", body, "\n</review> ")).when(C("pos") % 4 == 1, text_of("<review>```json\n", body, "\n```</review>")).when(C("pos") % 4 == 2, text_of("so: ", body, " done")).otherwise(F.lit("{broken}"))


column("payload_slice_parse", T.reviews, ["pos"], lambda: {"grade": G.grade_from_payload(X.review_payload(boxed())), "fenced": X.review_payload(boxed(), fences=False).isNotNull()}, T.REVIEWS, "CASE WHEN pos % 4 <> 3 THEN grade END AS grade, pos % 4 <> 3 AS fenced", "reviews")
column("review_signature", T.reviews, ["pos"], lambda: {"signature": F.to_json(X.review_signature(boxed()))}, T.REVIEWS, """CASE WHEN pos % 4 <> 3 THEN '{"grade":' || grade || ',"verdict":"accept","functional":' || (pos % 2 = 0) || ',"repair_effort":"none","evidence_type":""}' END AS signature""", "reviews")
NORMAL = rf"trim(regexp_replace(regexp_replace(replace(lower({{}}), '{X.NOTE}', ' '), '</?(step|review)>', ' ', 'g'), '[^a-z0-9_]+', ' ', 'g'))"
column("similarity_normalize", documents, ["doc_id"], lambda: {"key": X.similarity_key(text_of("<step>", C("text"), "</step> <b> Premature final review draft retained as a reasoning note, not as the final scored review:"))}, "", NORMAL.format("'<step>' || text || '</step> <b> Premature final review draft retained as a reasoning note, not as the final scored review:'") + " AS key", "documents")
S = sql_strip("text")
column("truncate_with_marker", documents, ["doc_id"], lambda: {**dict(zip(("cut", "was_cut"), X.truncate(C("text"), 300), strict=True)), "all": X.truncate(C("text"), 0)[0]}, "", f"CASE WHEN length({S}) > 300 THEN {sql_rstrip(f'left({S}, 300)')} || {quoted(X.TRUNCATED)} ELSE {S} END AS cut, length({S}) > 300 AS was_cut, {S} AS all", "documents")
column("elide_middle", documents, ["doc_id"], lambda: {"cut": X.elide_middle(C("text"), 101)}, "", "CASE WHEN length(text) > 101 THEN left(text, 50) || '...' || right(text, 51) ELSE text END AS cut", "documents")


def programs() -> Column:
    """Documents as prose, code in a fence, code, or code that is announced."""
    return F.when(C("doc_id") % 4 == 0, C("text")).when(C("doc_id") % 4 == 1, text_of("see\n```python\n", C("text"), "\nreturn 1\n```\nend")).when(C("doc_id") % 4 == 2, text_of("x = 1\nlet y = 2\n", C("text"))).otherwise(text_of("To solve this, return ", C("text")))


PROGRAMS = "pr AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'return 1' WHEN 2 THEN 'x = 1' || chr(10) || 'let y = 2' || chr(10) || text ELSE 'To solve this, return ' || text END AS raw FROM documents), b AS (SELECT doc_id, " + sql_strip("raw") + " AS b FROM pr)"
MARKS = " OR ".join(f"contains(b, '{m}')" for m in ("def ", "class ", "import ", "from ", "#include", "int main", "public ", "private ", "function ", "return ", "const ", "let ", "var ", "=>", "std::", "System.out"))
PROSE = " OR ".join("starts_with(lower(b), '{}')".format(m.replace("'", "''")) for m in ("an effective method", "the function", "to solve ", "the correct approach", "here's how", "we need to", "this solution", "the implementation", "the proposed solution", "the solution provided", "writing a "))
column("looks_like_code", documents, ["doc_id"], lambda: {"code": X.looks_like_code(programs())}, PROGRAMS, f"length(b) >= 12 AND ({MARKS}) AND NOT ({PROSE}) AS code", "b")
column("code_fence", documents, ["doc_id"], lambda: {"code": X.code_block(programs()), "python": X.python_block(programs()), "blocks": X.code_blocks(programs())}, PROGRAMS, "b AS code, b AS python, CASE WHEN doc_id % 4 = 1 THEN b || chr(10) ELSE '' END AS blocks", "b")
EVIDENCE = " OR ".join(f"contains(lower(x), '{m}')" for m in ("fails", "incorrect", "wrong", "exception", "runtime error", "syntax error", "does not", "missing", "mismatch", "counterexample", "test", "expected", "actual"))
column("concrete_evidence", documents, ["doc_id"], lambda: {"concrete": X.concrete_evidence(text_of(C("text"), F.when(C("doc_id") % 3 == 0, " It FAILS.").otherwise(" line 3 returned 4.")))}, "e AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' It FAILS.' ELSE ' line 3 returned 4.' END AS x FROM documents)", f"({EVIDENCE}) AS concrete", "e")
column("public_tests_format", documents, ["doc_id"], lambda: {"tests": X.format_tests(F.when(C("doc_id") % 5 != 0, F.split("text", "\n")))}, "t AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN string_split(text, chr(10)) END AS t FROM documents)", f"CASE WHEN t IS NULL THEN '{X.NO_TESTS}' WHEN len(t) > 5 THEN array_to_string(t[1:5], {NL}) || {NL} || '... (' || (len(t) - 5) || ' more assertions omitted)' ELSE array_to_string(t, {NL}) END AS tests", "t")
column("assertion_select", documents, ["doc_id"], lambda: {"n": F.size(X.assertions(F.array(text_of("  assert f() == ", C("source")), F.lit("assertion"), C("text"), F.lit("assert x"))))}, "", "CAST(2 + CASE WHEN starts_with(text, 'assert ') THEN 1 ELSE 0 END AS INT) AS n", "documents")


def _instruction_sql(inside: bool) -> str:
    task, code = sql_strip("source || ' ' || text"), sql_strip("text")
    cut = lambda x, n, mark: f"CASE WHEN length({x}) > {n} THEN {sql_rstrip(f'left({x}, {n})')} || {mark} ELSE {x} END"
    mark = quoted(X.TRUNCATED) if inside else "''"
    notes = f"CASE WHEN length({task}) > 200 THEN {quoted(X.PROBLEM_CUT)} ELSE '' END"
    if not inside:
        notes = f"CASE WHEN length({code}) > 100 THEN {quoted(X.CODE_CUT)} ELSE '' END || {notes}"
    parts = [quoted(X.INSTRUCTION[0] + "Task description:\n"), cut(task, 200, quoted(X.TRUNCATED)), quoted("\n\nCandidate code:\n```"), "subset", NL, cut(code, 100, mark), quoted("\n```\n\nAvailable tests:\n"), f"'{X.HIDDEN_TESTS}'", quoted("\n\n" + X.INSTRUCTION[1]), notes]
    return " || ".join(f"({p})" for p in parts)


def _instruction(inside: bool) -> Column:
    return X.instruction(text_of(C("source"), " ", C("text")), C("text"), C("subset"), F.lit(None).cast("array<string>"), problem_chars=200, code_chars=100, mark_inside=inside)


column("instruction_projection", T.samples, ["doc_id"], lambda: {"marked": _instruction(True), "noted": _instruction(False)}, T.SAMPLES, f"{_instruction_sql(True)} AS marked, {_instruction_sql(False)} AS noted", "samples")
SCORED = " || ".join(f"({x})" for x in (quoted(X.SCORE_INSTRUCTION + "Language: "), "'unknown'", quoted("\n\nTask description:\n"), sql_strip("source"), quoted("\n\nCandidate code:\n```\n"), f"CASE WHEN length({S}) > 10000 THEN {sql_rstrip(f'left({S}, 10000)')} || {quoted(X.TRUNCATED)} ELSE {S} END", quoted("\n```\n\nAdditional context:\n"), "lang"))
column("score_instruction", documents, ["doc_id"], lambda: {"instruction": X.score_instruction(C("source"), C("text"), F.lit(None).cast("string"), C("lang"))}, "", f"{SCORED} AS instruction", "documents")
column("task_text", documents, ["doc_id"], lambda: {"task": X.task_text(F.when(C("doc_id") % 2 == 0, C("lang")), C("source"), F.when(C("doc_id") % 3 == 0, F.lit("x = 1")))}, "", f"CASE WHEN doc_id % 2 = 0 THEN lang || {NL} || {NL} || source ELSE source END || CASE WHEN doc_id % 3 = 0 THEN {quoted(chr(10) * 2 + 'Starter code:' + chr(10) + 'x = 1')} ELSE '' END AS task", "documents")
column("stop_truncation", documents, ["doc_id"], lambda: {"cut": X.truncate_on_stop(C("text"), ["the ", "th", ". "])}, "p AS (SELECT doc_id, text, nullif(instr(text, 'the '), 0) AS a, nullif(instr(text, 'th'), 0) AS b, nullif(instr(text, '. '), 0) AS c FROM documents)", "CASE WHEN a IS NOT NULL AND a <= coalesce(b, a) AND a <= coalesce(c, a) THEN left(text, a + 3) WHEN b IS NOT NULL AND b <= coalesce(c, b) THEN left(text, b + 1) WHEN c IS NOT NULL THEN left(text, c + 1) ELSE text END AS cut", "p")
column("file_name_part", documents, ["doc_id"], lambda: {"part": X.file_part(F.when(C("doc_id") % 3 == 0, text_of("/", C("source"), " ", C("lang"), ".é?")).when(C("doc_id") % 3 == 1, F.lit("..")))}, "", "CASE doc_id % 3 WHEN 0 THEN source || '_' || lang || '_é' ELSE 'unknown' END AS part", "documents")
column("fingerprint", documents, ["doc_id"], lambda: {"print": X.fingerprint(C("text"), C("doc_id"), n=16)}, "", "left(sha256(text || doc_id), 16) AS print", "documents")


def _canonical_sql(exact: bool) -> str:
    means = "[" + ", ".join(f"'{G.DESCRIPTIONS[k]}'" for k in range(6)) + "][grade + 1]"
    head = f"""'<review>' || {NL} || '{{"axiom_grade": ' || grade || ', "score": ' || grade * 20 || '.0, "verdict": "' || {VERDICT.format("grade")} || '", "functional_correctness": ' || (grade >= 3) || ', "repair_effort": "' || {EFFORTS}[grade + 1] || '", '"""
    if exact:
        tail = f"""'"evidence_type": "uncertain", "summary": "' || {means} || '", "evidence": ["Use AXIOM grade ' || grade || ': ' || {means} || '", "{X.EXACT_EVIDENCE}"]}}'"""
    else:
        effort = "[" + ", ".join(f"'{X.EFFORT_EVIDENCE[k]}'" for k in range(6)) + "][grade + 1]"
        tail = f"""'"summary": "' || {means} || '", "evidence": ["' || CASE WHEN grade >= 3 THEN '{X.FUNCTIONAL_EVIDENCE[True]}' ELSE '{X.FUNCTIONAL_EVIDENCE[False]}' END || '", "' || {effort} || '"]}}'"""
    return f"{head} || {tail} || {NL} || '</review>'"


column("canonical_review", T.graded, ["doc_id"], lambda: {"review": X.review_text(C("grade")), "exact": X.review_text(C("grade"), exact=True)}, T.SAMPLES, f"{_canonical_sql(False)} AS review, {_canonical_sql(True)} AS exact", "graded")


def segments_raw() -> Column:
    k = C("pos") % 5
    return F.when(k == 0, text_of(" <step>", C("text"), "</step> ")).when(k == 1, text_of("<step>", C("text"))).when(k == 2, C("text")).when(k == 3, text_of("<step>so</step> <review> ", C("text"), " </review> tail")).otherwise("  ")


ST = sql_strip("text")
column("segment_normalize", T.turns, ["rec", "pos"], lambda: {"segment": X.normalize_segment(segments_raw())}, T.TURNS, f"CASE pos % 5 WHEN 0 THEN '<step>' || text || '</step>' WHEN 1 THEN {sql_rstrip('''('<step>' || text)''')} || {NL} || '</step>' WHEN 2 THEN '<step>' || {NL} || {ST} || {NL} || '</step>' WHEN 3 THEN '<review>' || {NL} || {ST} || {NL} || '</review>' END AS segment", "turns")
column("rollout_text", T.turns, ["rec", "pos"], lambda: {"review": X.close_review(text_of("<review>", C("text"))), "step": X.step_text(segments_raw())}, T.TURNS, f"{sql_rstrip('''('<review>' || text)''')} || {NL} || '</review>' AS review, CASE pos % 5 WHEN 0 THEN '<step>' || text || '</step>' WHEN 1 THEN {sql_rstrip('''('<step>' || text)''')} || {NL} || '</step>' WHEN 2 THEN '<step>' || {NL} || {ST} || {NL} || '</step>' WHEN 3 THEN '<step>so</step>' ELSE '<step>' || {NL} || {NL} || '</step>' END AS step", "turns")
column("output_unwrap", T.turns, ["rec", "pos"], lambda: {"action": X.unwrap_review(segments_raw())["action"], "final": X.unwrap_review(segments_raw())["final_answer"], "code": X.unwrap_code(text_of("a <code>", C("text"), "</code> <code>last</code>"))["final_answer"], "last": X.unwrap_code(text_of("a <code>", C("text"), "</code> <code>last</code>"), last=True)["final_answer"]}, T.TURNS, f"CASE pos % 5 WHEN 3 THEN '' WHEN 4 THEN '' ELSE {ST} END AS action, CASE pos % 5 WHEN 3 THEN {sql_strip('''(text || ' </review> tail')''')} ELSE '' END AS final, text AS code, 'last' AS last", "turns")
column("pair_role", documents, ["doc_id"], lambda: {"role": X.pair_role(F.when(C("doc_id") % 4 == 0, "Pos_Response").when(C("doc_id") % 4 == 1, "NEGATIVE").when(C("doc_id") % 4 == 2, "chosen"))}, "", "CASE doc_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' ELSE '' END AS role", "documents")
column("chunk_sequence", documents, ["doc_id"], lambda: {"chunks": F.array_join(F.transform(X.chunks(F.split("text", " "), 3), lambda c: F.array_join(c, "+")), "|")}, "w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)", "array_to_string([array_to_string(w[i:i + 2], '+') FOR i IN range(1, len(w) + 1, 3)], '|') AS chunks", "w")
column("terminal_error", T.reviews, ["pos"], lambda: {"error": X.terminal_error(F.when(C("pos") % 4 == 0, "").when(C("pos") % 4 == 1, '{"error": "timeout"}').when(C("pos") % 4 == 2, "{torn").otherwise("{}"))}, T.REVIEWS, "CASE pos % 4 WHEN 1 THEN 'timeout' WHEN 2 THEN 'invalid_reward_details' END AS error", "reviews")
column("float_sequence", T.reviews, ["pos"], lambda: {"values": F.aggregate(X.float_sequence(F.when(C("pos") % 3 != 0, F.array(C("grade").cast("string"), F.lit("x"))), F.array(C("q").cast("string"), F.lit("2"), F.lit(None).cast("string"))), F.lit(0.0), lambda a, x: a + x)}, T.REVIEWS, "CASE WHEN pos % 3 <> 0 THEN grade + 2.0::DOUBLE - 100.0 ELSE q + 2.0::DOUBLE - 100.0 END AS values", "reviews")
column("pad_sequence", documents, ["doc_id"], lambda: {"right": F.array_join(X.pad(F.split("text", " "), F.lit(400), F.lit("-")), " "), "left": F.array_join(X.pad(F.split("text", " "), F.lit(400), F.lit("-"), left=True), " ")}, "w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)", "array_to_string(list_concat(w, list_transform(range(400 - len(w)), lambda i: '-')), ' ') AS \"right\", array_to_string(list_concat(list_transform(range(400 - len(w)), lambda i: '-'), w), ' ') AS \"left\"", "w")


# recovery, similarity, claims ---------------------------------------------------------------------------------------------------------
#: Texts and what must come of them: one for each way of recovery. The expectations are the twin, so that it doesn't share the code's rule.
RECOVERIES = [
    ('<review>{"axiom_grade": 5}</review> <review>{"axiom_grade": 2}}</review>', True, None, 2, "balanced_json_prefix"),
    ('<review>{"axiom_grade": 3, "note": "a\nb"}</review>', True, None, 3, "escaped_control_chars"),
    ('<review>{"axiom_grade": 4, "score": 80, "evidence": ["torn</review>', True, None, 4, "grade_fallback"),
    ('<review>{"axiom_grade": 1}</review>', True, None, 1, None),
    ('<review>so: {"axiom_grade": 0} ok</review>', True, None, 0, None),
    ('{"axiom_grade": 4}', False, "missing_review_tags", None, None),
    ("<review>nothing</review>", False, "invalid_review_json", None, None),
    ('<review>{"a": {"axiom_grade": 5</review>', True, None, 5, "grade_fallback"),
]


def _sql(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x).upper()


@query(f"WITH {T.REVIEWS} SELECT pos, r.ok AS ok, r.error AS error, r.grade AS grade, r.method AS method FROM reviews JOIN (VALUES {', '.join(f'({k}, {_sql(ok)}, {_sql(e)}, {_sql(g)}, {_sql(m)})' for k, (_, ok, e, g, m) in enumerate(RECOVERIES))}) r(k, ok, error, grade, method) ON r.k = pos % {len(RECOVERIES)}")
def final_review_recovery(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce(*[F.when(C("pos") % len(RECOVERIES) == k, t) for k, (t, *_) in enumerate(RECOVERIES)])
    out = T.reviews(s, d).withColumn("r", udfs.recover_review(text))
    return out.select("pos", C("r.ok").alias("ok"), C("r.error").alias("error"), F.get_json_object("r.payload", "$.axiom_grade").cast("int").alias("grade"), C("r.method").alias("method"))


@query()
def near_duplicate_steps(s: SparkSession, d: str) -> DataFrame:
    """Adjacent turns whose normalized texts are near duplicates."""
    one = T.turns(s, d).withColumn("key", X.similarity_key(C("text")))
    pairs = one.withColumn("before", F.expr("lag(key) over (partition by rec order by pos)"))
    return pairs.select("rec", "pos", udfs.near(C("before"), C("key")).alias("near"))


@query(f"WITH {T.REVIEWS} SELECT pos, pos || ' % ' || (pos % 7 - 3) || ' returns ' || (pos % 3) AS claim, pos % 7 <> 3 AND pos - (pos % 7 - 3) * floor(pos / (pos % 7 - 3)::DOUBLE) = pos % 3 AS supported FROM reviews")
def modulo_claims(s: SparkSession, d: str) -> DataFrame:
    text = text_of("so ", C("pos"), " % ", C("pos") % 7 - 3, " returns ", C("pos") % 3, ", and 5 % x = 1")
    return T.reviews(s, d).select("pos", F.inline(X.modulo_claims(text))).select("pos", "claim", "supported")


@query(f"WITH {T.REVIEWS} SELECT pos, CASE WHEN pos % 3 = 0 THEN 'parameter `a` is never used' ELSE 'variable ''c'' was ignored' END AS claim, CASE WHEN pos % 3 = 0 THEN false ELSE pos % 2 = 1 END AS supported FROM reviews")
def unused_identifier(s: SparkSession, d: str) -> DataFrame:
    code = text_of("def f(a, b):\n    c = a\n    return ", F.when(C("pos") % 2 == 0, "c").otherwise("b"))
    text = F.when(C("pos") % 3 == 0, "The parameter `a` is never used, it seems").otherwise("variable 'c' was ignored")
    return T.reviews(s, d).select("pos", F.inline(udfs.unused_identifiers(text, code)))


#: A review's claims about `def f(x): return x + 1` and how many of them hold, given what runs of f(1) and f('a') gave.
CLAIMS = [("f(1) returns 2", 1, 0), ("f(1) returns 3", 0, 1), ("f('a') raises TypeError", 1, 0), ("f(1) returns 2 instead of 5", 1, 1), ("f(1) returns 2 instead of 2", 2, 0), ("f(x) returns 2", 0, 0), ("g(1) returns 2", 0, 0), ("f(9) returns 10", 0, 1), ("7 % -3 = -2", 1, 0)]
RAN = json.dumps({"f(1)": {"status": "result", "value": "2"}, "f('a')": {"status": "exception", "exception": "TypeError"}})


@query(f"WITH {T.REVIEWS} SELECT pos, CAST(r.t AS INT) AS true_claims, CAST(r.f + CASE WHEN pos % 2 = 0 THEN 1 ELSE 0 END AS INT) AS false_claims FROM reviews JOIN (VALUES {', '.join(f'({k}, {t}, {f})' for k, (_, t, f) in enumerate(CLAIMS))}) r(k, t, f) ON r.k = pos % {len(CLAIMS)}")
def evidence_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims of calls, exceptions and failed tests against runs that were made elsewhere: here all listed tests pass."""
    claim = F.coalesce(*[F.when(C("pos") % len(CLAIMS) == k, c) for k, (c, *_) in enumerate(CLAIMS)])
    payload = F.to_json(F.struct(F.array(claim).alias("evidence"), F.when(C("pos") % 2 == 0, "provided_test_failure").otherwise("uncertain").alias("evidence_type")))
    made = udfs.check_evidence(payload, F.lit("def f(x): return x + 1"), F.array(F.lit("assert f(1) == 2")), F.lit(1.0), F.lit(RAN), F.lit(None).cast("array<boolean>"))
    return T.reviews(s, d).withColumn("r", made).select("pos", C("r.true_claim_count").alias("true_claims"), C("r.false_claim_count").alias("false_claims"))


@query(f"WITH {T.REVIEWS} SELECT pos, CASE pos % 3 WHEN 0 THEN 'Unsupported executable claim: ''f() returns ' || pos || '''; actual result was ''7''.|Reward cap triggered by verifier: unsupported_unused_identifier_evidence.' WHEN 1 THEN 'Unsupported provided-test-failure evidence: full_test_pass_rate=1.0.' ELSE '' END AS messages FROM reviews")
def verifier_messages(s: SparkSession, d: str) -> DataFrame:
    one = text_of('{"evidence_details": {"fact_checks": [{"claim": "f() returns ', C("pos"), '", "supported": false, "actual": {"status": "result", "value": "7"}}, {"claim": "ok", "supported": true}]}, "reward_caps": [{"reason": "unsupported_unused_identifier_evidence"}, {"reason": "other"}]}')
    two = F.lit('{"evidence_details": {"fact_checks": [{"kind": "provided_test_failure", "supported": false, "actual": {"full_test_pass_rate": 1.0}}]}}')
    details = F.when(C("pos") % 3 == 0, one).when(C("pos") % 3 == 1, two).otherwise("{torn")
    return T.reviews(s, d).select("pos", F.array_join(udfs.verifier_messages(details), "|").alias("messages"))
