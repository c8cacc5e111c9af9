"""Verdict columns: one definition each of infrastructure failures, demotion, and pass predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Closed set of infrastructure codes, and the channels whose claim is trusted (fixed values).
INFRA_CODES = (
    "backend_configuration", "scheduler_failure", "trusted_payload_integrity", "trusted_golden_failure", "trusted_reference_configuration", "trusted_reference_failure",
    "trusted_runtime_dependency", "trusted_source_integrity", "worker_bootstrap_timeout", "worker_capture_setup", "worker_construction", "worker_start",
)
TRUSTED_CHANNELS = ("trusted_control_plane", "trusted_cpu_wrapper")


def truthy(c: Column) -> Column:
    """Null counts as false; for strict comparison use ``c.eqNullSafe(True)``."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def is_infra(origin: Column, infra_error: Column, code: Column, skipped: Column | None = None, stage: Column | None = None) -> Column:
    """The single predicate by which a row leaves the denominator."""
    out = F.coalesce(origin == "infrastructure", F.lit(False)) | (truthy(infra_error) & F.coalesce(code.isin(*INFRA_CODES), F.lit(False)))
    if skipped is not None:
        out = out | truthy(skipped)
    if stage is not None:
        out = out | F.coalesce(stage == "ref_smoke_failed", F.lit(False))
    return out


def gate(claim: Column, code: Column, channel: Column) -> dict[str, Column]:
    """Accept an infrastructure claim only from a trusted channel with a known code; otherwise demote it, keeping the original."""
    ok = truthy(claim) & F.coalesce(channel.isin(*TRUSTED_CHANNELS), F.lit(False)) & F.coalesce(code.isin(*INFRA_CODES), F.lit(False))
    return {
        "failure_origin": F.when(ok, "infrastructure").when(truthy(claim), "model"),
        "infra_code": F.when(ok, code),
        "original_code": F.when(truthy(claim) & ~ok, code),
        "classification_reason": F.when(ok, "accepted").when(~truthy(claim), "no_claim").when(~F.coalesce(channel.isin(*TRUSTED_CHANNELS), F.lit(False)), "untrusted_channel").otherwise("unknown_code"),
    }


def require_known_code(code: Column) -> Column:
    """The code, or an error for one outside the closed set."""
    return F.when(code.isNull() | code.isin(*INFRA_CODES), code).otherwise(F.raise_error(F.concat(F.lit("unknown infrastructure code: "), code)))


def all_passed(tests: Column, result: str = "result", errors: Column | None = None) -> Column:
    """No error, at least one test, and every test's result (1 when missing) is 0."""
    ok = (F.coalesce(F.size(tests), F.lit(0)) > 0) & F.forall(tests, lambda t: F.coalesce(t[result], F.lit(1)) == 0)
    return F.coalesce(ok if errors is None else ok & (errors == 0), F.lit(False))


def all_timed_out(messages: Column, phrases: tuple[str, ...] = ("timed out", "timeout")) -> Column:
    """At least one non-empty message, and every one of them names a timeout."""
    said = F.filter(messages, lambda m: F.length(F.trim(m)) > 0)
    hit = lambda m: F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(m), p))
    return (F.size(said) > 0) & F.forall(said, hit)


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """First matching name of an ordered list of conditions."""
    out = F.when(steps[0][0], steps[0][1])
    for cond, name in steps[1:]:
        out = out.when(cond, name)
    return out.otherwise(otherwise)


def error_class(status: Column, message: Column) -> Column:
    """Kind of an upstream error from its status code and message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return ladder((m.rlike("quota|insufficient"), "quota"), (m.rlike("membership|subscription"), "membership"), (status.isin(408, 425, 429) | (status >= 500), "transient"), ((status >= 400) & (status < 500), "client"), otherwise="other")


def backoff(attempt: Column, base: float = 3.0, cap: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(cap))


def reward(correct: Column, compiled: Column, infra: Column) -> Column:
    """Scalar of a verdict ladder; an unjudged row has none."""
    return F.when(infra, F.lit(None).cast("double")).when(truthy(correct), 1.0).when(truthy(compiled), 0.1).otherwise(0.0)


#: Backends whose outcomes may be trusted, and outcomes that stand for an infrastructure code (fixed values).
CPU_BACKENDS = ("rtl", "cvdp", "archxbench", "archxbench_tb", "realbench", "verilogeval", "rtllm")
PAYLOAD_OUTCOMES = ("payload_not_allowlisted", "invalid_verifier_payload")
REFERENCE_OUTCOMES = ("invalid_verify_mode", "profile_backend_mismatch")
RUNTIME_OUTCOMES = ("dependency_missing", "cvdp_runtime_unavailable", "archxbench_runtime_unavailable", "selfcheck_tb_runtime_unavailable", "realbench_runtime_unavailable", "rtl_benchmark_runtime_unavailable", "missing_simulator_binary")
GOLDEN_OUTCOMES = ("invalid_golden_or_ports", "testbench_generation_failed")
TRIGGERS = {"no_testbench": "trusted_reference_configuration", "query_failed": "scheduler_failure"}
TERMINAL = ("compile_fail", "compile_timeout", "test_fail", "timeout", "too_short")


def outcome_code(backend: Column, info: Column, error_type: Column) -> Column:
    """Infrastructure code that a backend's outcome stands for; null for a judged one."""
    rtl = backend == "rtl"
    code = (
        F.when(info.isin(*PAYLOAD_OUTCOMES), "trusted_payload_integrity")
        .when(info.isin(*REFERENCE_OUTCOMES) & (error_type == "dataset_configuration_error"), "trusted_reference_configuration")
        .when(info.isin(*RUNTIME_OUTCOMES), "trusted_runtime_dependency")
        .when(rtl & info.isin(*GOLDEN_OUTCOMES), "trusted_reference_configuration")
        .when(rtl & ((info == "golden_trace_incomplete") | info.startswith("golden_") & (error_type == "golden_verifier_failure")), "trusted_golden_failure")
    )
    return F.when(backend.isin(*CPU_BACKENDS), code)


def triggered(trigger: Column, syntax: Column, score: Column, policy: Column) -> Column:
    """(infra, infra_code, correct, info) of a sample by its trigger; a row that has a policy already is left out (null)."""
    code = F.coalesce(*[F.when(trigger == t, c) for t, c in TRIGGERS.items()])
    correct = truthy(syntax) & (F.coalesce(score, F.lit(0.0)) >= 100.0)
    info = F.when(code.isNotNull(), F.concat(F.lit("archx_infra:"), trigger)).when(correct, "pass").otherwise("fail")
    return F.when(policy.isNull(), F.struct(code.isNotNull().alias("infra"), code.alias("infra_code"), (code.isNull() & correct).alias("correct"), info.alias("info")))


def by_profile(info: Column, origin: Column, digest: Column, expected: Column) -> Column:
    """(correct, info) after comparison with the digests of a profile; terminal outcomes stay, a missing digest or profile is no pass."""
    stays = F.coalesce(info.isin(*TERMINAL), F.lit(False)) | F.coalesce(origin == "infrastructure", F.lit(False))
    bare = digest.isNull() | (digest == "") | expected.isNull()
    hit = F.coalesce(F.array_contains(expected, digest), F.lit(False))
    out = lambda ok, name: F.struct(ok.alias("correct"), name.alias("info"))
    return F.when(stays, out(F.lit(None).cast("boolean"), info)).when(bare, out(F.lit(False), F.lit("executed_no_profile"))).otherwise(out(hit, F.when(hit, "pass").otherwise("stdout_hash_mismatch")))


def kernel_missing(error: Column) -> Column:
    """A verifier that did not find the kernel failed, not the kernel."""
    return F.coalesce(error.startswith("Kernel not found"), F.lit(False))
