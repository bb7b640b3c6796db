import itertools
import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def box(*ranges):
    """Cells of a box; one half-open range stands for all three axes."""
    ranges = ranges * 3 if len(ranges) == 1 else ranges
    return list(itertools.product(*[range(a, b) for a, b in ranges]))


CELLS = "case_id string, i int, j int, k int, value int"


def cell_table(spark, rows):
    return spark.createDataFrame([(c, int(i), int(j), int(k), int(v)) for c, (i, j, k), v in rows], CELLS)


def mask(spark, parts, case="a"):
    """Cells of ``[(value, cells), ...]`` for one case."""
    return cell_table(spark, [(case, cell, value) for value, cells in parts for cell in cells])


def flood(volume):
    """Breadth-first labelling in C order, the yardstick for the Spark labelling."""
    out, n = np.zeros(volume.shape, int), 0
    for start in zip(*np.nonzero(volume)):
        if out[start]:
            continue
        n += 1
        out[start], queue = n, [start]
        while queue:
            cell = queue.pop()
            for axis in range(3):
                for step in (-1, 1):
                    near = list(cell)
                    near[axis] += step
                    near = tuple(near)
                    if 0 <= near[axis] < volume.shape[axis] and volume[near] and not out[near]:
                        out[near] = n
                        queue.append(near)
    return out


def volume_cells(spark, volumes):
    """Cells of ``{case: array}``."""
    return cell_table(spark, [
        (case, cell, int(v[cell])) for case, v in volumes.items() for cell in zip(*np.nonzero(v))
    ])
