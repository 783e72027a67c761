import pytest
from pyspark.sql import functions as F

from pagewright.operators import costs
from pagewright.plans import sidecar
from pagewright.sources import catalog

SPECS = "name string, bandwidth double, memory_gb double, cc_major int, cc_minor int, clock_mhz double, bus string"
PROBES = "gpu string, memory_gb double, cc_major int, cc_minor int, clock_mhz double, pcie_gen int, pcie_width int"


def test_gpus(spark):
    specs = spark.createDataFrame(
        [("L4", 300.0, 24.0, 8, 9, 2040.0, "PCIe 4.0 x16"), ("A10 PCIe", 600.0, 24.0, 8, 6, 1695.0, "PCIe 4.0 x16"), ("H100 PCIe 80 GB", 2039.0, 80.0, 9, 0, 1755.0, "PCIe 5.0 x16"), ("H100 PCIe 96 GB", 3360.0, 96.0, 9, 0, 1755.0, "PCIe 5.0 x16"),
         ("H100 old", 100.0, 80.0, 9, 0, 1755.0, "PCIe 3.0 x16"), ("A100 SXM", 1555.0, 40.0, 8, 0, 1410.0, None), ("A100 SXM4", 1000.0, 40.0, 8, 0, 1410.0, None), ("Zero", 0.0, 1.0, 1, 1, 1.0, None)], SPECS,
    )
    rows = [("NVIDIA L4", None, None, None, None, None, None), ("NVIDIA A10", None, None, None, None, None, None), ("H100 PCIe", 79.0, 9, 0, 1755.0, 5, 16), ("H100", 81.0, 9, 0, None, 5, 16), ("Tesla A100", 40.0, 8, 0, None, None, None), ("H100 ", None, None, None, None, None, None), ("Zero", None, None, None, None, None, None), ("X1", None, None, None, None, None, None)]
    got = {r.gpu: r.name for r in costs.match_gpus(spark.createDataFrame(rows, PROBES), specs).collect()}
    assert got == {"NVIDIA L4": "L4", "NVIDIA A10": "A10 PCIe", "H100 PCIe": "H100 PCIe 80 GB", "H100": "H100 PCIe 80 GB", "Tesla A100": "A100 SXM4", "H100 ": None, "Zero": None, "X1": None}


def test_rights(spark):
    df = spark.createDataFrame([("Public Domain",), ("CC BY 4.0",), ("All rights reserved",), ("?",), (None,)], "rights_json string")
    got = catalog.classified(df)
    assert [r.classification for r in got.collect()] == ["public_domain", "licensed", "in_copyright", None, None]
    assert tuple(catalog.parsed_share(got).first()) == (5, 3)
    assert catalog.classified(df, lambda c: F.lit("x")).filter("parsing_success").count() == 5


def test_sidecars(tmp_path):
    path = str(tmp_path / "a/info.json")
    assert sidecar.read(path) is None
    sidecar.merge(path, {"setup": {"a": 1, "b": 2}})
    assert sidecar.merge(path, {"setup": {"b": 3}, "refresh": {"c": 4}}, {"setup", "refresh"}) == sidecar.read(path) == {"setup": {"a": 1, "b": 3}, "refresh": {"c": 4}}
    with pytest.raises(ValueError):
        sidecar.merge(path, {"other": {}}, {"setup"})
    with pytest.raises(TypeError):
        sidecar.write(path, {"x": object()})
    assert sidecar.read(path)["refresh"] == {"c": 4} and [p.name for p in (tmp_path / "a").iterdir() if "info.json." in p.name and not p.name.endswith("lock")] == []
