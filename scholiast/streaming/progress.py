"""Progress of jobs from their event logs, in batch and as a stream: the same fold."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = 7
# --- fixed values: prompt -> (title, detail, stage) --------------------------------------------
PROMPTS = {
    "key_idea_extraction": ("Reading the paper", "identifying the main ideas that will guide the highlights.", 1),
    "document_selection": ("Selecting highlights", "choosing the passages that should be marked in the annotated PDF.", 2),
    "page_note_generation": ("Writing margin notes", "turning the selected highlights into short study notes.", 3),
    "equation_candidate_screen": ("Screening equations", "filtering the equations down to the ones worth explaining.", 4),
    "equation_selection": ("Choosing equations", "deciding which equations should receive annotations.", 5),
    "equation_explanation": ("Explaining equations", "writing plain-language explanations for the selected equations.", 6),
    "equation_explanation_retry": ("Rewriting an equation note", "trying again on an explanation that did not meet the quality bar.", 6),
    "equation_evaluation": ("Checking equation notes", "verifying the explanation quality before rendering the PDF.", 7),
    "equation_evaluation_retry": ("Rechecking an equation note", "running another verification pass on a revised explanation.", 7),
}
UNKNOWN = ("Processing the paper", "updating the annotated PDF pipeline.", 1)
# -----------------------------------------------------------------------------------------------


def looked_up(prompt: Column, i: int) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[i])) for k, v in PROMPTS.items()))
    return F.coalesce(m[F.coalesce(prompt, F.lit(""))], F.lit(UNKNOWN[i]))


def percent(stage: Column, latest_type: Column) -> Column:
    """A finished stage counts whole, one under way a little less; halves round to even."""
    r = F.when(latest_type == "response", stage / STAGES).otherwise(F.greatest(stage - 0.45, F.lit(0.35)) / STAGES)
    return F.bround(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))).cast("int")


def message(title: Column, detail: Column, latest_type: Column, started: Column, completed: Column) -> Column:
    busy = F.format_string("%s: %s Step %d is in progress and %d model steps are complete.", title, detail, started, completed)
    return F.when(latest_type == "request", busy).otherwise(F.format_string("%s finished. %s %d model steps are complete.", title, detail, completed))


def fold(events: DataFrame) -> DataFrame:
    """One row a job that has a request or response: counters, stage, percent, message. Works on streams too (update or complete mode).

    The latest type and prompt are maxima by sequence number, so late rows change nothing but what they should, and state is a few values a job.
    """
    kind, prompt = F.nullif(F.btrim("type"), F.lit("")), F.nullif(F.btrim("prompt_name"), F.lit(""))
    e = events.select("job_id", "seq", kind.alias("type"), prompt.alias("prompt"))
    g = e.groupBy("job_id").agg(
        F.count_if(F.col("type") == "request").alias("started_steps"),
        F.count_if(F.col("type") == "response").alias("completed_steps"),
        F.max_by("type", F.when(F.col("type").isNotNull(), F.col("seq"))).alias("latest_type"),
        F.max_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("seq"))).alias("current_prompt"),
    )
    g = g.where("started_steps + completed_steps > 0")
    title, detail, stage = (looked_up(F.col("current_prompt"), i) for i in range(3))
    said = message(title, detail, F.col("latest_type"), F.col("started_steps"), F.col("completed_steps"))
    return g.select("job_id", "started_steps", "completed_steps", "current_prompt", title.alias("stage_title"), detail.alias("stage_detail"), stage.alias("stage_index"), F.lit(STAGES).alias("total_stages"), percent(stage, F.col("latest_type")).alias("progress_percent"), said.alias("message"))


def job_view(jobs: DataFrame) -> DataFrame:
    """What an interface shows of a job; links exist once it has succeeded."""
    done = F.col("status") == "succeeded"
    link = F.concat(F.lit("/api/jobs/"), F.col("job_id"), F.lit("/annotated.pdf"))
    return jobs.select("job_id", "filename", "status", F.initcap("status").alias("status_label"), F.when(done, link).alias("pdf_url"), F.when(done, F.concat(F.lit("/viewer?file="), F.url_encode(link))).alias("viewer_url"))


def transitions(log: DataFrame) -> DataFrame:
    """(job_id, status, valid): each state of a job and whether it may follow the one before: queued, running, then succeeded or failed."""
    from pyspark.sql import Window

    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("updated_at"))
    ok = (before.isNull() & (F.col("status") == "queued")) | ((before == "queued") & (F.col("status") == "running")) | ((before == "running") & F.col("status").isin("succeeded", "failed"))
    return log.select("job_id", "updated_at", "status", F.coalesce(ok, F.lit(False)).alias("valid"))
