"""Keyword features of issue texts for priority models."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallygrove.session import text_batches

#: The pattern of each family of terms, on lower-cased text.
FAMILIES = {
    "has_crash_terms": r"\b(?:crash|crashes|crashed|segfault|segmentation fault|fatal|abort|aborted|core dump)\b",
    "has_regression_terms": r"\b(?:regression|regressed|worked before|no longer works|used to work|previously worked|since update)\b",
    "has_data_loss_terms": r"\b(?:data loss|lost data|loses data|corrupt|corrupted|delete[sd]? files?|overwrite[sd]?|cannot recover)\b",
    "has_blocking_terms": r"\b(?:blocker|blocking|blocks?|cannot proceed|unusable|showstopper|critical|must fix)\b",
    "has_api_break_terms": r"\b(?:api break|breaking api|binary incompat|source incompat|incompatible api|api change)\b",
    "has_stack_trace": r"\b(?:exception|traceback|stack trace|at org\.|java\.lang\.|nullpointerexception|caused by)\b",
    "has_exception_terms": r"\b(?:exception|npe|null pointer|assertion|assert failed|abortcompilation|outofmemory|oom)\b",
    "has_freeze_hang_terms": r"\b(?:freeze|freezes|hang|hangs|hung|deadlock|not responding|locks? up)\b",
    "has_performance_terms": r"\b(?:slow|performance|timeout|times out|takes too long|memory leak|cpu|high memory)\b",
    "has_install_update_terms": r"\b(?:install|installation|update|upgrade|migration|startup|launch|fails to start)\b",
    "has_security_terms": r"\b(?:security|vulnerability|exploit|permission|privilege|authentication|authorization)\b",
    "has_build_break_terms": r"\b(?:build break|breaks build|compile error|compilation error|cannot compile|build failed)\b",
    "has_test_failure_terms": r"\b(?:test failure|unit test|failing test|tests fail|junit)\b",
    "has_ui_block_terms": r"\b(?:dialog cannot close|button disabled|cannot save|cannot open|wizard fails)\b",
    "has_startup_launch_terms": r"\b(?:startup|launch|workspace startup|fails to start|cannot start|start up|initialization failed)\b",
    "has_internal_error_terms": r"\b(?:internal error|logged error|error log|\.log|workspace log|problems occurred when invoking code)\b",
    "has_widget_disposed_terms": r"\b(?:widget is disposed|disposed widget|swt\.swtexception|invalid thread access)\b",
    "has_breakpoint_terms": r"\b(?:breakpoint|breakpoints|watchpoint|suspend event|resume event|stack frame|invalidstackframe)\b",
    "has_preferences_terms": r"\b(?:preferences|preference page|installed jre|settings page|properties page)\b",
    "has_update_manager_terms": r"\b(?:update manager|feature update|installing feature|update site|feature\.xml|hand-rolled feature)\b",
    "has_repository_terms": r"\b(?:repository|cvs|svn|git|checkout|check out|commit|merge|load project from repository)\b",
    "has_save_cancel_terms": r"\b(?:save could not be completed|save problems|cannot save|cancel does not work|overwrite|copying files)\b",
    "has_search_refactor_terms": r"\b(?:search result|search view|refactor|refactoring|quick fix|content assist|open declaration)\b",
    "has_workspace_project_terms": r"\b(?:workspace|project import|import project|project metadata|classpath|build path|workspace corrupt)\b",
    "has_editor_terms": r"\b(?:editor|source editor|text editor|compare editor|content assist|quick fix|refactoring)\b",
    "has_debug_terms": r"\b(?:debug|debugger|breakpoint|watchpoint|step into|step over|launch configuration)\b",
    "has_compiler_terms": r"\b(?:compiler|incremental builder|compile|javac|syntax error|type resolution)\b",
    "has_pde_osgi_terms": r"\b(?:plugin|plug-in|osgi|bundle|manifest|feature.xml|extension point)\b",
    "has_git_team_terms": r"\b(?:git|egit|cvs|svn|repository|merge conflict|checkout|commit)\b",
    "has_repro_steps_terms": r"\b(?:steps to reproduce|reproduce|reproducible|expected result|actual result|how to reproduce)\b",
    "has_workaround_terms": r"\b(?:workaround|work around|temporary fix|can avoid|manual fix)\b",
    "has_enhancement_request_terms": r"\b(?:enhancement|feature request|nice to have|wish|would like|request for)\b",
    "has_minor_visual_terms": r"\b(?:typo|cosmetic|spelling|label|icon|color|formatting|alignment)\b",
    "has_file_line_stack_terms": r"\b[a-zA-Z0-9_.$/-]+\.(?:java|xml|class|properties):[0-9]+\b",
}
#: Families whose flags are summed to signals of high, second and low priority.
HIGH = "crash_terms regression_terms data_loss_terms blocking_terms api_break_terms stack_trace exception_terms freeze_hang_terms security_terms build_break_terms startup_launch_terms"
BOUNDARY = (
    "regression_terms stack_trace exception_terms build_break_terms editor_terms debug_terms compiler_terms repro_steps_terms internal_error_terms widget_disposed_terms "
    "breakpoint_terms preferences_terms update_manager_terms repository_terms save_cancel_terms search_refactor_terms"
)
LOW = "workaround_terms enhancement_request_terms minor_visual_terms test_failure_terms"
SIGNALS = {name: [f"has_{f}" for f in words.split()] for name, words in (("high_priority", HIGH), ("p2_boundary", BOUNDARY), ("low_priority", LOW))}
#: Patterns that are counted or flagged apart.
STACK_LINE = r"(?:\bat\s+[a-zA-Z0-9_.$]+\(|\.java:[0-9]+|caused by:|exception)"
BUILD_ID = r"\b(?:build id|buildid|i20[0-9]{6,})\b"
VERSION = r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)?\b"


#: Families a match of which may begin with no letter where the last one ended: counts look at what is before, which RE2 forgets then.
JOINED = {f for f in FAMILIES if f in ("has_internal_error_terms", "has_file_line_stack_terms")}


def _pieces(batch, most: int = 8 << 20):
    """Slices of a batch of about ``most`` bytes, as a batch holds whole texts."""
    rows = max(1, batch.num_rows * most // max(most, batch.nbytes))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _matches(texts: pa.Array, name: str) -> pa.Array:
    n = pc.count_substring_regex(texts, FAMILIES[name]).cast(pa.int32())
    if name not in JOINED:
        return n
    n, whole = n.to_numpy().copy(), re.compile(FAMILIES[name], re.ASCII)
    for i in np.flatnonzero(n).tolist():
        n[i] = sum(1 for _ in whole.finditer(texts[i].as_py()))
    return pa.array(n)


def _terms(batches):
    """Rows (id, summary, description, other columns) as (id, flags and counts of families, flags of ids and versions, other columns)."""
    for batch in batches:
        for part in _pieces(batch):
            summary = part["_s"]
            text = pc.binary_join_element_wise(summary, part["_d"], "\n")
            flag = lambda t, p: pc.match_substring_regex(t, p).cast(pa.int32())
            out = {part.schema.names[0]: part.column(0)}
            for name, pattern in FAMILIES.items():
                n = _matches(text, name)
                out |= {name: pc.greater(n, 0).cast(pa.int32()), f"summary_{name}": flag(summary, pattern), f"{name}_count": n}
            out |= {"contains_build_id": flag(text, BUILD_ID), "contains_version_number": flag(text, VERSION)}
            out |= {c: part[c] for c in part.schema.names[3:]}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def keyword_features(df: DataFrame, id_col: str, summary: Column, description: Column) -> DataFrame:
    """One row for each row of df: of each family a flag and count in the text and a flag in the summary, sums of flags, lengths and counts. Nulls count as empty.

    Families are matched by RE2, whose time doesn't grow with the alternatives of a pattern, and in which words are of ASCII.
    """
    text_batches(df.sparkSession)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    rows = df.select(id_col, low(summary).alias("_s"), low(description).alias("_d"))
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    cols = {
        "summary_char_len": F.length("_s"), "description_char_len": F.length("_d"), "summary_word_count": words(F.col("_s")),
        "description_word_count": words(F.col("_d")), "description_line_count": F.regexp_count("_d", F.lit("\n")) + 1,
        "stack_trace_line_count": F.regexp_count("_d", F.lit(STACK_LINE)), "summary_exclamation_count": F.regexp_count("_s", F.lit("!")),
    }
    names = [*[x for f in FAMILIES for x in (f, f"summary_{f}", f"{f}_count")], "contains_build_id", "contains_version_number", *cols]
    form = StructType([df.schema[id_col], *[StructField(c, IntegerType()) for c in names]])
    met = rows.select(id_col, "_s", "_d", *[c.cast("int").alias(n) for n, c in cols.items()]).mapInArrow(_terms, form)
    out = met.select(id_col, *[c for c in COLUMNS if c in names])
    total = lambda names, head="": sum((F.col(head + n) for n in names[1:]), F.col(head + names[0]))
    sums = {f"{k}_signal_count": total(v) for k, v in SIGNALS.items()}
    sums |= {f"summary_{k}_signal_count": total(SIGNALS[k], "summary_") for k in ("high_priority", "p2_boundary")}
    sums["priority_signal_balance"] = total(SIGNALS["high_priority"]) - total(SIGNALS["low_priority"])
    return out.withColumns(sums)


#: Result columns besides the id, all integers.
COLUMNS = [
    *[x for f in FAMILIES for x in (f, f"summary_{f}", f"{f}_count")],
    "summary_char_len", "description_char_len", "summary_word_count", "description_word_count", "description_line_count", "stack_trace_line_count",
    "summary_exclamation_count", "contains_build_id", "contains_version_number", "high_priority_signal_count", "p2_boundary_signal_count",
    "low_priority_signal_count", "summary_high_priority_signal_count", "summary_p2_boundary_signal_count", "priority_signal_balance",
]
