"""Checks that refuse to run on what does not fit, and fitted heads that carry theirs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each family's patch side and architecture.
FAMILIES = {"dinov3": (16, "dinov3_vitb16"), "dinov2": (14, "dinov2_vitb14")}


def family_defaults(family: str) -> dict:
    """Patch side and architecture of a family of backbones."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family}; one of {sorted(FAMILIES)}")
    return dict(zip(("patch", "arch"), FAMILIES[family]))


def same_contract(wanted: dict, found: dict) -> None:
    """Raise if two descriptions of features differ in what both name."""
    differ = {k: (wanted[k], found[k]) for k in wanted.keys() & found.keys() if wanted[k] != found[k]}
    if differ:
        raise ValueError("features do not fit: " + ", ".join(f"{k} is {b}, not {a}" for k, (a, b) in sorted(differ.items())))


def need_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def checked(value: Column, holds: Column, message: str) -> Column:
    """``value``, or an error at run time where the condition fails."""
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)))


def save_head(model, contract: dict, path: str) -> None:
    """A fitted model and the features that it was fitted on (size, patch, family)."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load_head(kind, path: str, contract: dict):
    """The model of a class, refused if the features at hand differ from those that it was fitted on."""
    spark = SparkSession.getActiveSession()
    same_contract(json.loads(spark.read.text(f"{path}/contract").first()["value"]), contract)
    return kind.load(f"{path}/model")
