"""Conversation memory: histories, budgets and cumulative summaries.

Turns are rows (conv_id, turn, role, text) with role `student` or `tutor`; others are left out, as
are turns without text. One conversation is one group; its state is bounded by the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .providers import ChatModel

ROLES = {"student": "Student", "tutor": "Tutor"}
SUMMARY, RECENT = "[SUMMARY OF THE CONVERSATION SO FAR]", "[LATEST TURNS]"


def turns(raw: DataFrame) -> DataFrame:
    """Known roles under one spelling; the rest is dropped."""
    role = F.lower(F.trim("role"))
    named = F.when(role.isin("user", "student"), "student").when(role.isin("assistant", "tutor"), "tutor")
    return raw.withColumn("role", named).where("role is not null and text is not null and conv_id is not null")


def last_turns(t: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def answered(t: DataFrame) -> DataFrame:
    """(conv_id, n_answers): how often the tutor speaks right after the student."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t.withColumn("_before", before).where("role = 'tutor' and _before = 'student'")
    return pairs.groupBy("conv_id").agg(F.count("*").alias("n_answers"))


def history(t: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(conv_id, history): the latest turns, labelled, in order."""
    label = F.concat(F.when(F.col("role") == "student", F.lit("Student")).otherwise(F.lit("Tutor")), F.lit(" : "), F.col("text"))
    recent = last_turns(t, config.history_window)
    ordered = F.array_sort(F.collect_list(F.struct("turn", label.alias("l"))))
    return recent.groupBy("conv_id").agg(F.concat(F.lit(RECENT + "\n"), F.array_join(F.transform(ordered, lambda x: x["l"]), "\n")).alias("history"))


def estimate(text: str) -> int:
    return int(len(text.split()) * 1.3)


def render(summary: str, recent: list[tuple[str, str]]) -> str:
    parts = [f"{SUMMARY}\n{summary}\n"] if summary else []
    if recent:
        parts += [RECENT, *[f"{ROLES[r]} : {t}" for r, t in recent]]
    return "\n".join(parts)


def within_budget(summary: str, recent: list[tuple[str, str]], budget: int) -> str:
    """The history with its oldest turns dropped until it fits; two always stay."""
    while len(recent) > 2 and estimate(render(summary, recent)) > budget:
        recent = recent[1:]
    return render(summary, recent)


def cut_words(text: str, n: int) -> str:
    w = text.split()
    return text if len(w) <= n else " ".join(w[:n]) + "..."


class Memory:
    """Turns since the last summary, and the summary of all before. `summarise` takes the summary
    so far and the turns to add; where it fails or is missing, the turns are cut to size instead,
    in place of the earlier summary."""

    def __init__(self, window: int = 6, words: int = 500, summarise: Callable[[str, str], str] | None = None) -> None:
        self.window, self.words, self.summarise = window, words, summarise
        self.turns: list[tuple[str, str]] = []
        self.summary = ""

    def add(self, role: str, text: str) -> None:
        if role not in ROLES:
            raise ValueError(f"unknown role {role}")
        self.turns.append((role, text))

    def compress(self) -> bool:
        """At twice the window the older half becomes part of the summary."""
        if self.window < 1 or len(self.turns) < 2 * self.window:
            return False
        old = "\n".join(f"{ROLES[r]} : {t}" for r, t in self.turns[: self.window])
        try:
            self.summary = self.summarise(self.summary, old) if self.summarise else cut_words(old, self.words)
        except Exception:
            self.summary = cut_words(old, self.words)
        self.turns = self.turns[self.window :]
        return True

    def history(self, budget: int = 4000) -> str:
        recent = self.turns[-self.window :] if self.window > 0 else self.turns
        return within_budget(self.summary, recent, budget)

    def clear(self) -> None:
        self.turns, self.summary = [], ""


SUMMARISER = "Continue the summary of a lesson between a student and a tutor. Keep names, open questions and what was agreed, in at most {words} words."


def summariser(model: ChatModel, words: int = 500) -> Callable[[str, str], str]:
    """A `summarise` for `Memory` by a chat model: the summary so far and the turns to add, to the new one."""

    def run(before: str, turns: str) -> str:
        parts = [f"SUMMARY SO FAR\n{before}"] if before else []
        return cut_words(model.complete(SUMMARISER.format(words=words), "\n\n".join([*parts, f"TURNS TO ADD\n{turns}"])), words)

    return run


def tell(parts: Iterable[str], put: Callable[[str], object]) -> str:
    """Passes on the parts of a streamed answer as they come, and gives the whole."""
    said: list[str] = []
    for p in parts:
        put(p)
        said.append(p)
    return "".join(said)


STATE = "conv_id long, n_turns int, n_kept int, summary string, history string"


def compressed(t: DataFrame, window: int = 6, config: EngineConfig = DEFAULT, summarise: Callable[[str, str], str] | None = None, budget: int | None = None) -> DataFrame:
    """The state after a conversation's last turn, compressing after each tutor turn."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        m = Memory(window, config.summary_words, summarise)
        for role, text in zip(pdf["role"], pdf["text"]):
            m.add(role, text)
            if role == "tutor":
                m.compress()
        return pd.DataFrame([(pdf["conv_id"].iloc[0], len(pdf), len(m.turns), m.summary, m.history(budget or config.history_tokens))], columns=["conv_id", "n_turns", "n_kept", "summary", "history"])

    return t.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(one, STATE)
