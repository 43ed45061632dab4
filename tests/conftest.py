import json

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def corpus(tmp_path):
    """Writes {galaxy: values} as cluster files and gives the root."""

    def write(galaxies, definitions=(), name="corpus"):
        root = tmp_path / name
        (root / "clusters").mkdir(parents=True)
        for kind, values in galaxies.items():
            (root / "clusters" / f"{kind}.json").write_text(json.dumps({"name": kind.title(), "type": kind, "uuid": f"g-{kind}", "version": 1, "values": values}))
        for i, d in enumerate(definitions):
            (root / "galaxies").mkdir(exist_ok=True)
            (root / "galaxies" / f"d{i}.json").write_text(d if isinstance(d, str) else json.dumps(d))
        return str(root)

    return write


def entry(uuid, value, *related, **meta):
    """A cluster value; related are (uuid, type) pairs."""
    out = {"uuid": uuid, "value": value} if uuid else {"value": value}
    if related:
        out["related"] = [{"dest-uuid": u, "type": t, "tags": []} for u, t in related]
    return out | ({"meta": meta} if meta else {})
