"""Free-text requests, in Spanish or English, read as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import schemas
from pagemill.functions.text import strip
from pagemill.functions.urls import urls_in

# Phrases that ask for clean text.
CLEAN_PHRASES = ["límpialo", "limpialo", "texto limpio", "recórtalo", "recortalo", "trim to", "clean to"]
CLEAN_JOB = "web_fetch_text_clean"

# Job -> patterns that ask for it, tried in this order.
ROUTES = {
    "web_status_codes": [
        r"\bc[oó]digos?\s*(de\s*)?(estado|http)\b",
        r"\bestados?\s*http\b",
        r"\bhttp\s*status\b",
        r"\bstatus\s*codes?\b",
    ],
    "web_h1_texts": [
        r"\b(h1|encabezad[oa]s?)\b",
        r"\bt[íi]tulo\s*principal\b",
        r"\bheaders?\s*h1\b",
    ],
    "web_links": [
        r"\benlaces?\b",
        r"\blinks?\b",
        r"\bhiperv[ií]nculos?\b",
        r"\bhref\b",
        r"\b<a>\b",
    ],
    "web_json_api": [
        r"\bjson\b",
        r"\bapi(s)?\b",
        r"\bendpoints?\b",
    ],
    "web_titles_hard": [
        r"\bt[íi]tulos?\b",
        r"\btitles?\b",
        r"\b<title>\b",
    ],
}
DEFAULT_JOB = "web_titles_hard"

# What a task states, and what a CSV listing task states besides.
METRIC = "correctness"
TIMEOUT_S = 30
LISTING_INPUT = "ruta"
LISTING_OUTPUT = "lista_csv_ordenados"


def route(prompt: Column) -> Column:
    """Job of a prompt: the first whose patterns occur, else the default."""
    text = F.lower(prompt)
    job = F.when(F.lit(False), "")
    for name, patterns in ROUTES.items():
        job = job.when(text.rlike("(?iU)" + "|".join(patterns)), name)
    return job.otherwise(DEFAULT_JOB)


def asks_clean_text(prompt: Column) -> Column:
    return F.lower(prompt).rlike("|".join(CLEAN_PHRASES))


def route_clean(prompt: Column) -> Column:
    """The two-way choice between clean text and titles."""
    return F.when(asks_clean_text(prompt), CLEAN_JOB).otherwise(DEFAULT_JOB)


def route_all(prompt: Column) -> Column:
    """Clean text where its phrases occur, otherwise `route`."""
    return F.when(asks_clean_text(prompt), CLEAN_JOB).otherwise(route(prompt))


def route_json(prompt: Column) -> Column:
    """The answer of the router as JSON: `{"skill": ...}`."""
    return F.to_json(F.struct(route(prompt).alias("skill")))


def routed_job(answer: Column) -> Column:
    """Job named by a router's JSON answer; the default where it is unreadable or names none."""
    skill = F.from_json(answer, "skill STRING")["skill"]
    return F.when(skill != "", skill).otherwise(DEFAULT_JOB)


def limit(prompt: Column) -> Column:
    """Number of characters asked for (`300 caracteres`), else NULL."""
    return F.regexp_extract(prompt, r"(?iU)([0-9]+)\s*caracter", 1).try_cast("int")


def request(prompt: Column) -> Column:
    """STRUCT<urls, limit>."""
    return F.struct(urls_in(prompt).alias("urls"), limit(prompt).alias("limit"))


def task_spec(prompt: Column) -> Column:
    """Task asked for: a sorted CSV listing if the prompt speaks of CSV, an open goal otherwise."""
    text = F.lower(prompt)
    is_csv = text.contains("csv")
    sort_by = F.when(text.contains("nombre") | text.contains("alfab"), "name").otherwise("size")
    order = F.when(text.contains("ascend"), "asc").otherwise("desc")
    nothing = F.create_map().cast("map<string,string>")
    return F.struct(
        strip(prompt).alias("goal"),
        F.when(is_csv, F.array(F.lit(LISTING_INPUT))).otherwise(F.array().cast("array<string>")).alias("inputs"),
        F.when(is_csv, F.create_map(F.lit("sort_by"), sort_by, F.lit("order"), order))
        .otherwise(nothing)
        .alias("constraints"),
        F.lit(METRIC).alias("metric"),
        F.lit(TIMEOUT_S).alias("timeout_s"),
        F.when(is_csv, F.create_map(F.lit("stdout"), F.lit(LISTING_OUTPUT)))
        .otherwise(nothing)
        .alias("io_contract"),
    ).cast(schemas.TASK_SPEC)
