"""Decisions as ordered CASE ladders over evidence columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that read, verbs that write, order of strictness, thresholds.
READS = tuple("get list search read find fetch query retrieve show view describe lookup browse count check inspect summarize info status tree directory".split())
WRITES = tuple(
    "add append approve archive assign book cancel change close commit create delete deploy edit email execute forward insert install invite kill mark merge modify move pay post publish "
    "push put remove rename replace reply restart run save schedule send set share start transfer update upload write clear destroy drop grant overwrite purge reset revoke truncate wipe "
    "apply attach authorize call clone comment connect detach disable dispatch download enable exec fork import invoke launch lock login logout mount notify pull register reject revert "
    "rollback stop submit subscribe sync toggle trigger unlock unsubscribe".split()
)
STRICTNESS = {"ALLOW": 0, "REVIEW": 1, "BLOCK": 2}
CALL_BUDGET, INJECTION_BLOCK, LEAST_ALIGNMENT, MUTATION_RISK = 4, 0.75, 0.60, 0.35


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The outcome of the first step that holds."""
    out = F.lit(otherwise)
    for condition, outcome in reversed(steps):
        out = F.when(condition, F.lit(outcome)).otherwise(out)
    return out


def tool_part(name: Column) -> Column:
    """What follows the first colon of `server:tool`; the whole name without one or with nothing behind it."""
    rest = F.regexp_extract(name, "^[^:]*:(.+)$", 1)
    return F.when(rest != "", rest).otherwise(name)


def spaced(name: Column) -> Column:
    return F.lower(F.regexp_replace(tool_part(name), "([a-z])([A-Z])", "$1 $2"))


def tool_words(name: Column) -> Column:
    """Words of the tool part, camel case cut; "pull request" is a noun and left out."""
    return F.regexp_extract_all(F.regexp_replace(spaced(name), r"pull[\W_]+requests?", " "), F.lit("[a-z0-9]+"), F.lit(0))


def is_mutation(name: Column) -> Column:
    """Any writing verb (also "check in" and "check out"), or no reading verb, in the tool part of `server:tool`."""
    words = tool_words(name)
    books = spaced(name).rlike(r"check[\W_]*(?:in|out)(?![a-z])")
    return books | F.arrays_overlap(words, F.array(*map(F.lit, WRITES))) | ~F.arrays_overlap(words, F.array(*map(F.lit, READS)))


def detection_score(hits: Column) -> Column:
    return F.when(hits == 0, F.lit(0.02)).otherwise(F.least(F.lit(0.99), F.lit(0.52) + F.lit(0.23) * hits))


def fused_risk(injection: Column, alignment: Column, mutation: Column) -> Column:
    return F.greatest(injection, F.lit(1.0) - alignment, F.when(mutation, F.lit(MUTATION_RISK)).otherwise(F.lit(0.0)))


def policy(call_index: Column, injection: Column, alignment: Column, mutation: Column, known: Column, prohibited: Column) -> Column:
    return ladder(
        (~known, "BLOCK:UNREGISTERED"),
        (prohibited, "BLOCK:PROHIBITED"),
        (call_index > CALL_BUDGET, "BLOCK:BUDGET"),
        (injection >= INJECTION_BLOCK, "BLOCK:INJECTION"),
        (alignment < LEAST_ALIGNMENT, "BLOCK:ALIGNMENT"),
        (mutation, "REVIEW:MUTATION"),
        otherwise="ALLOW",
    )


def stricter(a: Column, b: Column) -> Column:
    rank = lambda c: F.when(c == "BLOCK", 2).when(c == "REVIEW", 1).otherwise(0)
    worst = F.greatest(rank(a), rank(b))
    return F.when(worst == 2, "BLOCK").when(worst == 1, "REVIEW").otherwise("ALLOW")


def verdict(*steps: tuple[Column, str, str]) -> Column:
    """struct<decision, reason> of the first step (condition, decision, reason) that holds, else allow; a null condition does not hold."""
    out = F.struct(F.lit("allow").alias("decision"), F.lit("").alias("reason"))
    for condition, decision, reason in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def session_flagged(flagged: Column, in_flight: Column, soft: Column, with_soft: bool = True) -> Column:
    """Flagged for good, a scan that has not ended, or (where it counts) soft bits."""
    hard = flagged | (in_flight > 0)
    return hard | (soft != 0) if with_soft else hard


def call_verdict(injected: Column, untrusted: Column, credential: Column, after_injection: Column, known: Column, sourced: Column, mutation: Column, flagged: Column, cut: Column, review: str = "tainted", sourced_reads: bool = False) -> Column:
    """Verdict on a tool call from its evidence, the first objection counting.

    injected: instructions in the arguments; untrusted: a value from a tainted output, or below a tainted URL; credential: one leaves that the user
    did not give (`after_injection`: in a session with taint or a flag); known: block, review or null from threat memory; sourced: a value
    from an earlier output; mutation: the tool writes; flagged: taint or a flag, soft ones included; cut: not all was read.  `review`: never,
    tainted or always ask.
    """
    asks = review != "never"
    yes = F.lit(asks)
    return verdict(
        (injected, "deny", "injected_arguments"), (untrusted, "deny", "tainted_value"), (credential & after_injection, "deny", "credential_after_injection"),
        (credential & yes, "ask", "credential"), (known == "block", "deny", "known_attack"), ((known == "review") & yes, "ask", "earlier_attack"),
        (sourced & yes & (F.lit(sourced_reads) | mutation), "ask", "sourced_value"), (mutation & (F.lit(review == "always") | (F.lit(review == "tainted") & flagged)), "ask", "flagged_session"),
        (cut & yes, "ask", "cut_input"),
    )


def precall_code(quarantined: Column, untrusted_intent: Column, credential: Column, any_taint: Column, tainted: Column, incomplete: Column, has_values: Column, traced: Column, foreign: Column, known: Column, sourced: Column, mutation: Column) -> Column:
    """Code of a gateway's check before a call, null for none: the first of the ladder that holds.

    traced: path, host or null; foreign: a value that another tool's description names; incomplete: taint was dropped, so any value is suspect.
    """
    steps = (
        (quarantined, "BLOCK_TOOL_QUARANTINED"), (untrusted_intent, "REVIEW_UNTRUSTED_ARGUMENT_SOURCE"), (credential & any_taint, "BLOCK_CREDENTIAL_EGRESS"), (credential, "REVIEW_CREDENTIAL_EGRESS"),
        (tainted | (has_values & incomplete), "BLOCK_UNTRUSTED_ARGUMENT_SOURCE"), (traced == "path", "BLOCK_UNTRUSTED_ARGUMENT_SOURCE"), (known == "block", "BLOCK_KNOWN_THREAT"), (known == "review", "REVIEW_KNOWN_THREAT"),
        (foreign, "REVIEW_UNTRUSTED_ARGUMENT_SOURCE"), ((sourced | (traced == "host")) & mutation, "REVIEW_UNTRUSTED_ARGUMENT_SOURCE"),
    )
    out = F.lit(None).cast("string")
    for condition, code in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def result_verdict(rules: Column, pack_block: Column, local: Column, collapsed: Column, memory: Column, hostile_source: Column, judged: Column, classified: Column, block_outputs: bool = False) -> Column:
    """struct<decision, evidence, taints, observes, soft> of a tool result: strong evidence taints the session, weak evidence warns and makes its values observed.

    All are booleans; rules and pack hits on local output (the user's own files) are weak.
    """
    strong = (rules | pack_block) & ~local
    evidence = ladder((strong & rules, "rules"), (strong, "pack"), ((rules | pack_block) & local, "local"), (collapsed, "collapsed"), (memory, "memory"), (hostile_source, "hostile_source"), (judged, "judge"), (classified, "classifier"), otherwise="none")
    return F.struct(
        F.when(strong & F.lit(block_outputs), "deny").otherwise("allow").alias("decision"), evidence.alias("evidence"), strong.alias("taints"),
        (~strong & (evidence != "none")).alias("observes"), (evidence == "judge").alias("soft"),
    )


def stricter_verdict(first: Column, second: Column, limit: Column, review_never: Column) -> Column:
    """deny over ask over allow; without review an ask of the second is dropped, unless a limit raised it: that is a deny."""
    second = F.when(review_never & (second == "ask"), F.when(limit, "deny").otherwise("allow")).otherwise(second)
    rank = lambda c: F.when(c == "deny", 2).when(c == "ask", 1).otherwise(0)
    worst = F.greatest(rank(first), rank(second))
    return F.when(worst == 2, "deny").when(worst == 1, "ask").otherwise("allow")


def worst_hit(hits: Column) -> Column:
    """struct<decision, reason> of array<struct<decision, reason, named>>: the first deny whose target the user did not name; denies that
    were all named soften to an ask; else the first ask the user did not name; else allow."""
    first = lambda condition: F.get(F.filter(hits, condition), 0)
    deny, soft, ask = first(lambda h: (h["decision"] == "deny") & ~h["named"]), first(lambda h: h["decision"] == "deny"), first(lambda h: (h["decision"] == "ask") & ~h["named"])
    told = lambda d, h: F.struct(F.lit(d).alias("decision"), h["reason"].alias("reason"))
    return F.when(deny.isNotNull(), told("deny", deny)).when(soft.isNotNull(), told("ask", soft)).when(ask.isNotNull(), told("ask", ask)).otherwise(F.struct(F.lit("allow").alias("decision"), F.lit("").alias("reason")))


def policy_full(**c: Column) -> Column:
    """The whole policy ladder as a code; arguments are boolean, number or string columns.

    registered, prohibited, allowed, schema_match, call_index, injection, missing_resource, missing_destination, valid_arguments,
    resource_ok, destination_ok, alignment, mutation, disposition (BLOCK, REVIEW, CLEAR), has_key, review_reason (null for none), approved, lenient_reads.
    """
    weak = (c["alignment"] < LEAST_ALIGNMENT) & (c["mutation"] | ~c["lenient_reads"] | (c["alignment"] == 0.0)) & ~(c["mutation"] & (c["disposition"] == "REVIEW"))
    return ladder(
        (~c["registered"], "BLOCK_TOOL_NOT_REGISTERED"), (c["prohibited"], "BLOCK_TOOL_PROHIBITED"), (~c["allowed"], "BLOCK_TOOL_NOT_ALLOWED"), (~c["schema_match"], "BLOCK_SCHEMA_DRIFT"),
        (c["call_index"] > CALL_BUDGET, "BLOCK_CALL_BUDGET_EXCEEDED"), (c["injection"] >= INJECTION_BLOCK, "BLOCK_INJECTION_DETECTED"), (c["missing_resource"], "BLOCK_RESOURCE_OUT_OF_SCOPE"),
        (c["missing_destination"], "BLOCK_DESTINATION_OUT_OF_SCOPE"), (~c["valid_arguments"], "BLOCK_INVALID_ARGUMENTS"), (~c["resource_ok"], "BLOCK_RESOURCE_OUT_OF_SCOPE"),
        (~c["destination_ok"], "BLOCK_DESTINATION_OUT_OF_SCOPE"), (weak, "BLOCK_INTENT_MISMATCH"), (c["disposition"] == "BLOCK", "BLOCK_SECURITY_AGENTS"),
        (c["mutation"] & ~c["has_key"], "BLOCK_IDEMPOTENCY_REQUIRED"), ((c["mutation"] | c["review_reason"].isNotNull()) & ~c["approved"], "REVIEW"),
        (c["mutation"], "ALLOW_APPROVAL_VERIFIED"), otherwise="ALLOW_POLICY_SATISFIED",
    )


# Verbs of a request that reads or writes, words of tool names that say nothing, negators.
READ_ACTIONS = tuple("read get list search find show view fetch check summarize summarise inspect retrieve".split())
WRITE_ACTIONS = tuple(
    "append approve assign cancel close create delete email forward move post remove rename send update upload write add edit replace insert modify change set save put push commit merge "
    "install publish schedule book pay transfer mark abort start restart deploy invite reply share archive".split()
)
GENERIC_TERMS = READ_ACTIONS + tuple("user users details detail info information all data item items to the a an and or of for in on at by with from me my i you your it is be can please".split())
NEGATED = r"\b(?:do\s+not|don't|never|must\s+not|stop)\b[^.!?]{0,80}\b"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def grounding(intent: Column, terms: Column, mutation: Column, tool_match: Column, schema_match: Column, resource_ok: Column, destination: Column, destination_ok: Column) -> Column:
    """struct<alignment, scope, reasons>: how far a request grounds a call.

    intent: the request; terms: words of the tool (string); resource_ok, destination_ok: null where the tool has no such field;
    destination: the address the call goes to.  0.95 grounded, 0.30 not, 0.55 at most where the address is not named, 0 if the request negates
    the action, or a tool, schema or scope does not match.
    """
    plain = F.regexp_replace(intent, "[‘’ʼ＇′]", "'")
    array = lambda xs: F.array(*map(F.lit, xs))
    family = F.when(mutation, array(WRITE_ACTIONS)).otherwise(array(READ_ACTIONS))
    said = _words(plain)
    either = lambda xs: rf"(?i){NEGATED}(?:{'|'.join(sorted(xs))})\w*\b"
    negated = F.when(mutation, plain.rlike(either(WRITE_ACTIONS))).otherwise(plain.rlike(either(READ_ACTIONS)))
    verb, subject = F.arrays_overlap(family, said), F.arrays_overlap(F.array_except(_words(terms), array(GENERIC_TERMS)), said)
    grounded = subject & (verb | ~mutation)
    base = F.when(negated, 0.0).when(grounded, 0.95).otherwise(0.30)
    named = F.regexp_extract_all(F.lower(plain), F.lit(r"(?:[a-z0-9_.+-]+)@[a-z0-9_-]+(?:\.[a-z0-9_-]+)+"), F.lit(0))
    there = F.when(F.size(named) > 0, F.array_contains(named, F.lower(destination))).otherwise(F.arrays_overlap(_words(F.split_part(destination, F.lit("@"), F.lit(1))), said))
    has, fits = destination_ok.isNotNull(), F.coalesce(destination_ok, F.lit(True)) & F.coalesce(resource_ok, F.lit(True))
    lifted = has & there & ~negated & ~grounded & verb
    level = F.when(lifted, 0.95).when(has & ~there, F.least(base, F.lit(0.55))).otherwise(base)
    hard = ~tool_match | ~schema_match | ~fits
    reasons = F.array_compact(F.array(
        F.when(tool_match, "TOOL_METADATA_MATCH").otherwise("TOOL_METADATA_MISMATCH"), F.when(schema_match, "SCHEMA_HASH_MATCH").otherwise("SCHEMA_HASH_MISMATCH"),
        F.when(negated, "ACTION_EXPLICITLY_NEGATED").when(grounded | lifted, "ACTION_GROUNDED").otherwise("ACTION_NOT_GROUNDED"),
        F.when(resource_ok, "RESOURCE_IN_SCOPE").when(~resource_ok, "RESOURCE_OUT_OF_SCOPE"),
        F.when(has & ~destination_ok, "DESTINATION_OUT_OF_SCOPE").when(has & there, "DESTINATION_GROUNDED").when(has, "DESTINATION_NOT_GROUNDED"),
    ))
    return F.struct(F.round(F.when(hard, 0.0).otherwise(level), 4).alias("alignment"), F.when(fits, 1.0).otherwise(0.0).alias("scope"), reasons.alias("reasons"))
