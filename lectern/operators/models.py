"""Injected clients of language models, over tables of requests; jobs and their guards.

A client is a function of one request (a dict) that gives an answer (a dict: text, input, output) or raises ModelError. Nothing
here opens a connection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import key_points

Client = Callable[[dict], dict]

# Attempts and waits, in seconds, of each kind of trouble, and how many chapters are asked about at once.
ATTEMPTS = {"Overloaded": (3, 1.0), "RateLimited": (3, 20.0)}
AT_ONCE = 3
CRASHES = 2


class ModelError(Exception):
    """kind: Overloaded, RateLimited, Unauthorized, Refused, Network or Failed."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def answered_once(client: Client, request: dict, wait: Callable[[float], None] = time.sleep) -> dict:
    """The client's answer, or what went wrong; tried again after n times the wait of its kind."""
    turn = 1
    while True:
        try:
            found = client(request)
            blank = not (found.get("text") or "").strip()
            return {"outcome": "Refused" if blank and found.get("blocked") else "Complete", **found}
        except ModelError as error:
            most, pause = ATTEMPTS.get(error.kind, (1, 0.0))
            if turn >= most:
                return {"outcome": error.kind, "text": None, "input": 0, "output": 0}
            wait(pause * turn)
            turn += 1


def answered(requests: DataFrame, factory: Callable[[], Client], at_once: int = AT_ONCE, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """request_id, outcome, text, input, output of requests (request_id, prompt, other columns), at most at_once at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            rows = []
            for request in batch.to_dict("records"):
                got = answered_once(client, request, wait)
                rows.append((request["request_id"], got["outcome"], got.get("text"), int(got.get("input") or 0), int(got.get("output") or 0)))
            yield pd.DataFrame(rows, columns=["request_id", "outcome", "text", "input", "output"])

    return requests.repartition(at_once).mapInPandas(run, "request_id long, outcome string, text string, input long, output long")


def ensured_points(chapters: DataFrame, saved: DataFrame, factory: Callable[[], Client], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """saved (chapter_id, status, points) with the missing chapters' (id, prompt, start_page, end_page) added: READY, or REFUSED; chapters that failed stay away."""
    asked = key_points.missing(chapters, saved).select(F.col("id").alias("request_id"), "prompt", "start_page", "end_page")
    told = answered(asked, factory, wait=wait).join(asked, "request_id")
    points = key_points.parsed(F.col("text"), F.col("start_page"), F.col("end_page"))
    status = F.when(F.col("outcome") == "Refused", "REFUSED").when(F.size(points) == 0, "EMPTY").otherwise("READY")
    new = told.where(F.col("outcome").isin("Complete", "Refused")).select(F.col("request_id").alias("chapter_id"), status.alias("status"), points.alias("points"))
    return saved.select("chapter_id", "status", "points").unionByName(new)


@dataclass
class Stages:
    """What may be bound to indexing; what is not is left out."""

    embed: Callable[[DataFrame], DataFrame] | None = None
    detect_chapters: Callable[[DataFrame], DataFrame] | None = None
    classify: Callable[[DataFrame], DataFrame] | None = None
    analyse_people: Callable[[DataFrame], None] | None = None
    judge_place: Callable[[DataFrame], DataFrame] | None = None
    speak: Callable[[DataFrame], DataFrame] | None = None

    def run(self, books: DataFrame, *names: str) -> DataFrame:
        """books through the stages named, in that order."""
        for name in names:
            stage = getattr(self, name)
            if stage is not None:
                found = stage(books)
                books = books if found is None else found
        return books


# Jobs -----------------------------------------------------------------------------------------------


def queued(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """jobs (book_id, asked_at, state) after requests (book_id, asked_at, replace): one job a book. A running or waiting one is kept unless a request replaces it; then the last that does counts."""
    first = asked.groupBy("book_id").agg(F.min("asked_at").alias("first"), F.max(F.when(F.col("replace"), F.col("asked_at"))).alias("replaced"))
    open_jobs = jobs.where(F.col("state").isin("WAITING", "RUNNING"))
    joined = open_jobs.join(first, "book_id", "full")
    at = F.coalesce("replaced", "asked_at", "first")
    state = F.when(F.col("replaced").isNotNull() | F.col("asked_at").isNull(), "WAITING").otherwise(F.col("state"))
    return joined.select("book_id", at.alias("asked_at"), state.alias("state"))


def guarded(events: DataFrame) -> DataFrame:
    """book_id, stage, crashes, skip of a log (book_id, stage, n: an order, what: begin, end, unsupported or update).

    A begin without an end is a crash; an end clears the count, an app update clears everything of the stage before it. CRASHES or an unsupported stage are skipped.
    """
    cleared = F.max(F.when(F.col("what").isin("end", "update"), F.col("n")))
    reset = events.groupBy("book_id", "stage").agg(cleared.alias("cleared"), F.max(F.when(F.col("what") == "update", F.col("n"))).alias("updated"))
    left = events.join(reset, ["book_id", "stage"])
    counted = left.groupBy("book_id", "stage").agg(
        F.count_if((F.col("what") == "begin") & (F.col("n") > F.coalesce("cleared", F.lit(-1)))).alias("crashes"),
        F.max(((F.col("what") == "unsupported") & (F.col("n") > F.coalesce("updated", F.lit(-1)))).cast("int")).alias("unsupported"),
    )
    return counted.select("book_id", "stage", "crashes", ((F.col("crashes") >= CRASHES) | (F.col("unsupported") == 1)).alias("skip"))


def intact(files: DataFrame, registry: DataFrame) -> DataFrame:
    """path, id, ok of files (path, content, as binaryFile reads them) whose digest is the one of the registry (id, path, sha256)."""
    return files.select("path", F.sha2("content", 256).alias("digest")).join(registry, "path").select("path", "id", (F.col("digest") == F.col("sha256")).alias("ok"))


def retry_left(attempts: Column, stage: Column) -> Column:
    """Whether a stage that failed so many times is tried again: indexing three times, scanning twenty, its uploads five."""
    return attempts < F.when(stage == "index", 3).when(stage == "scan", 20).otherwise(5)
