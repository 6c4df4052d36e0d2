"""Run-log parsing helpers (F29, F31, P35): column expressions over log lines."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run-name vocabularies, tried in this order, first contained entry wins.
# method/model/dataset are matched on the lower-cased file name, the rest on the name as is.
# The epoch list holds '_50__100_' as one entry (two adjacent literals in the reference list).
RUN_NAME_LISTS = {
    "method": ["ft_rm_general", "ft_rm", "rag", "prm", "id_rm", "vae", "gpo", "pretrained"],
    "model": ["gemma", "llama", "starling", "rm-mistral"],
    "dataset": ["psoups", "summarization", "personal_llm", "ultrafeedback"],
    "train_size": ["200000", "100000", "30000", "10000", "3000", "1000", "300"],
    "learning_rate": ["3e-6", "5e-5", "0.0003", "1e-5", "0.0001", "3e-5", "1e-06", "5e-06", "1e-4", "3e-4", "1e-3"],
    "epoch": ["_1_", "_2_", "_3_", "_5_", "_10_", "_20_", "_30_", "_50__100_"],
}
LOWER_CASE_FIELDS = {"method", "model", "dataset"}

# Category names in logs -> metric names.
CATEGORY_METRIC = {"chat": "chat", "chat hard": "chat_hard", "safety": "safety", "reasoning": "reasoning"}
METRICS = ["accuracy", "chat", "chat_hard", "safety", "reasoning"]

# The six log line shapes (training header, user line, named and numbered
# dataset lines, dictionary line and its items, per-user eval line).
NUM = r"([\d.]+)"
P_HEADER = r"Training and Evaluating for user (\d+)"
P_USER = r"Metrics for User (\d+): " + NUM
P_DATASET_NAME = r"Metrics for dataset \['([^']+)'\]: " + NUM
P_DATASET_NUM = r"Metrics for dataset \[(\d+)\]: " + NUM
P_DICT = r"User accuracy: \{([^}]+)\} for model .+"
P_DICT_ITEM = r"(?:'([^']+)'|(\d+)): ([\d.]+|nan)"
P_PRM = r"eval_rewards/user_(\d+)_accuracies: " + NUM


def run_config(name: Column) -> dict[str, Column]:
    """Per field, the first list entry contained in the file name (``NA`` if none)."""
    out = {}
    for field, values in RUN_NAME_LISTS.items():
        subject = F.lower(name) if field in LOWER_CASE_FIELDS else name
        e = None
        for v in values:
            cond = subject.contains(v)
            e = F.when(cond, F.lit(v)) if e is None else e.when(cond, F.lit(v))
        out[field] = e.otherwise(F.lit("NA"))
    return out


def log_format(path: Column) -> Column:
    """Which parser applies, from the path: rag, ft_rm (training, id fallback), prm, id_rm, else all."""
    p = F.lower(path)
    return (F.when(p.contains("rag"), "rag").when(p.contains("ft_rm"), "ft_rm")
             .when(p.contains("prm"), "prm").when(p.contains("id_rm"), "id_rm").otherwise("all"))


def parse_line(line: Column) -> Column:
    """one line -> struct(kind, uid, dataset, value) for the six line shapes (NULL kind if none).

    A dictionary line yields kind ``dict`` and its raw body in ``dataset``;
    ``dict_items`` expands it.
    """
    def ext(p, i):
        return F.regexp_extract(line, p, i)

    def has(p):
        return line.rlike(p)
    kind = (F.when(has(P_HEADER), "header").when(has(P_USER), "user")
             .when(has(P_DATASET_NAME), "dataset_name").when(has(P_DATASET_NUM), "dataset_num")
             .when(has(P_DICT), "dict").when(has(P_PRM), "prm"))
    uid = (F.when(has(P_HEADER), ext(P_HEADER, 1)).when(has(P_USER), ext(P_USER, 1))
            .when(has(P_DATASET_NUM), ext(P_DATASET_NUM, 1)).when(has(P_PRM), ext(P_PRM, 1))).cast("long")
    dataset = F.when(has(P_DATASET_NAME), ext(P_DATASET_NAME, 1)).when(has(P_DICT), ext(P_DICT, 1))
    value = (F.when(has(P_USER), ext(P_USER, 2)).when(has(P_DATASET_NAME), ext(P_DATASET_NAME, 2))
              .when(has(P_DATASET_NUM), ext(P_DATASET_NUM, 2)).when(has(P_PRM), ext(P_PRM, 2))).cast("double")
    return F.struct(kind.alias("kind"), uid.alias("uid"), dataset.alias("dataset"), value.alias("value"))


def dict_items(body: Column) -> Column:
    """Items of a dictionary line in order: array<struct<pos, name, uid, value>>."""
    names = F.regexp_extract_all(body, F.lit(P_DICT_ITEM), F.lit(1))
    nums = F.regexp_extract_all(body, F.lit(P_DICT_ITEM), F.lit(2))
    vals = F.regexp_extract_all(body, F.lit(P_DICT_ITEM), F.lit(3))
    z = F.arrays_zip(names.alias("n"), nums.alias("u"), vals.alias("v"))
    return F.transform(z, lambda x, i: F.struct(
        i.alias("pos"),
        F.when(F.length(x["n"]) > 0, x["n"]).alias("name"),
        F.when(F.length(x["u"]) > 0, x["u"].cast("long")).alias("uid"),
        F.when(x["v"] == "nan", F.lit(float("nan"))).otherwise(x["v"].cast("double")).alias("value")))


class RunTable:
    """The metrics of one run, built from its parsed lines in order.

    Each parser keeps its own part, so that one pass over the lines serves all of them and ``rows`` puts them
    together as if they had run one after the other over the whole file: training, dictionary, per-user
    evaluation, id.  ``state`` is plain data, so a stream can carry a run from batch to batch.
    """

    PARTS = ("train", "dict", "prm", "id")
    #: the parsers of each format, in order; a training log without metrics is read by ids as well
    FORMATS = {"rag": ("dict",), "ft_rm": ("train",), "prm": ("prm",), "id_rm": ("id",), "all": PARTS}

    def __init__(self, fmt: str, state: dict | None = None):
        self.fmt = fmt
        state = state or {}
        self.header: int | None = state.get("header")
        self.seen_dict: bool = state.get("seen_dict", False)
        self.last: dict[str, float] = state.get("last", {})
        self.parts: dict[str, dict[int, dict[str, float]]] = {
            p: {int(u): m for u, m in state.get(p, {}).items()} for p in self.PARTS}

    @property
    def state(self) -> dict:
        return {"header": self.header, "seen_dict": self.seen_dict, "last": self.last, **self.parts}

    def feed(self, kind: str, uid: int | None, dataset: str | None, value: float | None) -> None:
        """One parsed line (``parse_line``)."""
        if kind == "header":
            self.header = uid
        elif kind == "user":
            self.parts["train"].setdefault(uid, {})["accuracy"] = value
        elif kind == "prm":
            self.parts["prm"].setdefault(uid, {})["accuracy"] = value
        elif kind == "dataset_num":
            self.parts["id"].setdefault(uid, {})["accuracy"] = value
        elif kind == "dataset_name" and dataset in CATEGORY_METRIC:
            metric = CATEGORY_METRIC[dataset]
            if self.header is not None:
                self.parts["train"].setdefault(self.header, {})[metric] = value
            for scores in self.parts["id"].values():
                scores[metric] = value
            self.last[metric] = value
        elif kind == "dict" and not self.seen_dict:
            self.seen_dict = True
            named: dict[str, float] = {}
            for name, user, number in re.findall(P_DICT_ITEM, dataset):
                if name:
                    if name in CATEGORY_METRIC:
                        named[CATEGORY_METRIC[name]] = float(number)
                else:
                    self.parts["dict"].setdefault(int(user), {}).update(accuracy=float(number), **named)

    def rows(self) -> list[tuple[int, str, float, str]]:
        """(uid, metric, value, user_kind); user 0 is the mean over the others, without NaN."""
        users: dict[int, dict[str, float]] = {}
        for part in self.FORMATS[self.fmt]:
            if part != "id":
                for u, scores in self.parts[part].items():
                    users.setdefault(u, {}).update(scores)
        if "id" in self.FORMATS[self.fmt] or (self.fmt == "ft_rm" and not any(users[u] for u in users if u != 0)):
            # a category line reaches everyone known before the id parser starts, and its own users so far
            for scores in users.values():
                scores.update(self.last)
            for u, scores in self.parts["id"].items():
                users.setdefault(u, {}).update(scores)
        out = [(u, m, v, "individual") for u, scores in users.items() if u != 0 for m, v in scores.items()]
        for metric in METRICS:
            values = [v for _, m, v, _ in out if m == metric and not math.isnan(v)]
            if values:
                out.append((0, metric, math.fsum(values) / len(values), "average"))
        return out


def category_metric(name: Column) -> Column:
    e = None
    for k, v in CATEGORY_METRIC.items():
        e = F.when(name == k, F.lit(v)) if e is None else e.when(name == k, F.lit(v))
    return e


def format_metric(value: Column, missing: str = "NA") -> Column:
    """``%.3f``; NaN -> ``nan``; missing -> ``NA`` (or ``-``)."""
    return (F.when(value.isNull(), F.lit(missing)).when(F.isnan(value), F.lit("nan"))
             .otherwise(F.format_string("%.3f", value)))
