"""The small files that a run reads beside its drafts: seed bank, panel, prices, recordings, manifests, earlier runs."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.seed import Bank
from .yaml_subset import load

PROVIDERS = ("openrouter", "anthropic", "openai", "judge")
EFFORTS = ("minimal", "low", "medium", "high")
MAX_RECORDING = 1 << 20
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


class FileError(ValueError):
    pass


def _json(path: str) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise FileError(f"{path}: {e}") from None


def _need(ok: object, why: str) -> None:
    if not ok:
        raise FileError(why)


def _filled(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


# --- seed bank -----------------------------------------------------------


def parse_bank(value: Any, where: str = "bank") -> Bank:
    _need(isinstance(value, dict) and value.get("version") == 2 and isinstance(value.get("rules"), dict), f"{where}: needs version 2 and rules")
    faults, negatives = {}, {}
    for rule, entry in value["rules"].items():
        _need(isinstance(entry, dict) and isinstance(entry.get("faults"), list) and entry["faults"], f"{where}: {rule} needs faults")
        for f in entry["faults"]:
            _need(isinstance(f, dict) and _filled(f.get("text")) and all(map(_filled, f.get("hosts", []))), f"{where}: {rule} has a fault without a text")
        for n in entry.get("hard_negatives", []):
            _need(isinstance(n, dict) and _filled(n.get("text")) and _filled(n.get("why")), f"{where}: {rule} has a near miss without text or why")
        faults[rule] = [(f["text"], list(f.get("hosts", []))) for f in entry["faults"]]
        negatives[rule] = [(n["text"], n["why"]) for n in entry.get("hard_negatives", [])]
    return Bank(faults, negatives)


def read_bank(path: str) -> Bank:
    return parse_bank(_json(path), path)


# --- panel and prices ------------------------------------------------------


@dataclass(frozen=True)
class PanelEntry:
    id: str
    provider: str
    match: str
    prefer: tuple[str, ...] = ()
    alternates: tuple[str, ...] = ()
    budget: int = 2000
    reasoning: str | None = None
    label: str = ""


def parse_panel(text: str, where: str = "panel") -> tuple[list[PanelEntry], dict[str, str]]:
    """(entries, price file by provider)."""
    value = load(text, where)
    _need(isinstance(value, dict) and value.get("version") == 1 and isinstance(value.get("models"), list) and value["models"], f"{where}: needs version 1 and models")
    out = []
    for m in value["models"]:
        _need(isinstance(m, dict) and _filled(m.get("id")), f"{where}: a model needs an id")
        at = f"{where}: {m['id']}"
        _need(m.get("provider") in PROVIDERS, f"{at}: provider must be one of {', '.join(PROVIDERS)}")
        _need(_filled(m.get("match")), f"{at}: needs match")
        try:
            re.compile(m["match"])
        except re.error as e:
            raise FileError(f"{at}: match is no pattern ({e})") from None
        lists = {}
        for k in ("prefer", "alternates"):
            v = m.get(k) or []
            v = [v] if isinstance(v, str) else v
            _need(isinstance(v, list) and all(map(_filled, v)), f"{at}: {k} must be a list of ids")
            lists[k] = tuple(v)
        budget = m.get("budget", 2000)
        _need(isinstance(budget, int) and not isinstance(budget, bool) and budget > 0, f"{at}: budget must be a positive whole number")
        effort = m.get("reasoning")
        _need(effort is None or (effort in EFFORTS and m["provider"] in ("openai", "openrouter")), f"{at}: reasoning does not fit {m['provider']}")
        out.append(PanelEntry(m["id"], m["provider"], m["match"], budget=budget, reasoning=effort, label=m.get("label") or m["id"], **lists))
    ids = [e.id for e in out]
    _need(len(set(ids)) == len(ids), f"{where}: two models have one id")
    prices = value.get("prices") or {}
    _need(isinstance(prices, dict) and all(_filled(v) for v in prices.values()), f"{where}: prices must name files")
    return out, prices


def panel_frame(spark: SparkSession, entries: list[PanelEntry]) -> DataFrame:
    rows = [(i, e.id, e.provider, e.match, list(e.prefer), list(e.alternates)) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "ord int, model_id string, provider string, match string, prefer array<string>, alternates array<string>")


def parse_prices(text: str, where: str = "prices") -> tuple[list[tuple[int, str, float, float]], str]:
    """(rows (ord, match, input, output) in dollars a token, citation)."""
    v = load(text, where)
    _need(isinstance(v, dict) and _filled(v.get("source")), f"{where}: needs a source")
    _need(DATE.fullmatch(str(v.get("verified_on", ""))), f"{where}: verified_on must be a date")
    _need(v.get("currency") == "usd_per_million_tokens", f"{where}: currency must be usd_per_million_tokens")
    _need(isinstance(v.get("models"), list), f"{where}: needs models")
    rows = []
    for i, m in enumerate(v["models"]):
        _need(isinstance(m, dict) and _filled(m.get("match")), f"{where}: a price needs match")
        both = [m.get("input"), m.get("output")]
        _need(all(isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 for x in both), f"{where}: {m['match']} needs input and output")
        rows.append((i, m["match"], both[0] / 1e6, both[1] / 1e6))
    return rows, f"{where} ({v['source']}), checked {v['verified_on']}"


# --- recordings --------------------------------------------------------------


@dataclass(frozen=True)
class Recording:
    run_date: str | None
    default: dict[str, float]
    phrases: list[tuple[str, dict[str, float]]]

    def judge(self):  # noqa: ANN201
        from ..operators.judge import Recorded

        return Recorded(self.phrases, self.default, last=True, model="replay")


def load_recording(folder: str, name: str) -> Recording:
    """A recording by name, from one folder and no other place."""
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, name if name.endswith(".json") else f"{name}.json"))
    _need(os.path.dirname(path) == root, f"{name}: not a recording of {folder}")
    _need(os.path.isfile(path), f"{name}: no such recording")
    _need(os.path.getsize(path) <= MAX_RECORDING, f"{name}: larger than {MAX_RECORDING} bytes")
    v = _json(path)
    _need(isinstance(v, dict) and isinstance(v.get("responses"), list) and isinstance(v.get("default"), dict), f"{name}: needs responses and a default")
    if v.get("measured"):
        _need(DATE.fullmatch(str(v.get("runDate", ""))), f"{name}: a measured recording needs its runDate")

    def nouls(x: dict) -> dict[str, float]:
        n = x.get("nouls")
        _need(isinstance(n, dict) and all(isinstance(p, (int, float)) and not isinstance(p, bool) and 0 <= p <= 1 for p in n.values()), f"{name}: nouls must be probabilities")
        return {k: float(p) for k, p in n.items()}

    for r in v["responses"]:
        _need(isinstance(r, dict) and isinstance(r.get("match"), str), f"{name}: a response needs match")
    return Recording(v.get("runDate"), nouls(v["default"]), [(r["match"], nouls(r)) for r in v["responses"]])


# --- manifests and earlier runs ------------------------------------------------


def read_twins(path: str) -> list[tuple[str, str, str]]:
    """(original, adversarial, injected sentence) of each pair."""
    v = _json(path)
    pairs = v.get("pairs") if isinstance(v, dict) else v
    _need(isinstance(pairs, list) and pairs, f"{path}: no pairs")
    for p in pairs:
        _need(isinstance(p, dict) and all(_filled(p.get(k)) for k in ("original", "adversarial", "sentence")), f"{path}: a pair needs original, adversarial and sentence")
    return [(p["original"], p["adversarial"], p["sentence"]) for p in pairs]


def read_eval_folder(spark: SparkSession, folder: str, classes: list[str]) -> DataFrame:
    """Documents of an earlier evaluation (id, kind, truth, text), if it was made for the same classes."""
    scores = _json(os.path.join(folder, "scores.json"))
    _need(scores.get("classes") == classes, f"{folder}: was made for other rules")

    def part(name: str, kind: str, needed: bool = True) -> DataFrame | None:
        path = os.path.join(folder, "inputs", f"{name}.json")
        if not os.path.exists(path) and not needed:
            return None
        raw = spark.read.schema("paragraphs array<struct<id: string, rule: string, text: string>>").json(path, multiLine=True)
        rows = raw.select(F.explode("paragraphs").alias("p"))
        truth = F.col("p.rule") if kind == "seeded" else F.lit(None).cast("string")
        return rows.select("p.id", F.lit(kind).alias("kind"), truth.alias("truth"), "p.text")

    out = part("clean", "clean").unionByName(part("seeded", "seeded"))
    negatives = part("negatives", "clean", needed=False)
    return out if negatives is None else out.unionByName(negatives)
