"""Command line: ``python -m ionweave.cli --mode rescoring --config c.json --input_path x.mgf --output_path out``."""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ionweave")
    p.add_argument("--mode", choices=("rescoring", "ea", "bin_reclassification"), required=True)
    p.add_argument("--config", help="JSON or YAML with settings, and the paths `network` (.npz), `scorer` and `lookup`")
    p.add_argument("--input_path", required=True)
    p.add_argument("--output_path", required=True)
    return p


def read_config(path: str) -> dict:
    """Settings from JSON or, where PyYAML is there or every line is ``key: value``, from YAML."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        found = {}
        for line in text.splitlines():
            key, colon, value = line.partition(" #")[0].partition(":")
            if key.strip() and not key.lstrip().startswith("#") and colon:
                try:
                    found[key.strip()] = json.loads(value)
                except ValueError:
                    found[key.strip()] = value.strip().strip("'\"")
        return found


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from ionweave.operators import model
    from ionweave.plans.api import Engine, Settings

    a = parser().parse_args(argv)
    values = read_config(a.config) if a.config else {}
    spark = SparkSession.builder.getOrCreate()
    engine = Engine(
        spark,
        model.Network.load(values["network"]) if "network" in values else None,
        model.Scorer.load(values["scorer"]) if "scorer" in values else None,
        settings=Settings.of(values),
    )
    if a.mode == "rescoring":
        engine.rescoring_from_mgf(a.input_path, a.output_path)
    elif a.mode == "ea":
        engine.search_from_mgf(a.input_path, values.get("lookup"), a.output_path)
    else:
        engine.bin_reclassification_from_mgf(a.input_path, a.output_path)


if __name__ == "__main__":
    main()
