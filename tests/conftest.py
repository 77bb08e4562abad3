import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siftframe.session import prepare

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)


@pytest.fixture(scope="session")
def messy(spark):
    """Eight customer rows with padding, nulls, a repeated row, mixed dates and malformed values."""
    rows = [
        (0, "K01", "Ana Ruiz", "ana@mail.com", "300", "Merino Wool", 11.0, "2025-03-01"),
        (1, "K02", "  Ben Okoro  ", "ben@mail", "2.5", "Merino-Wool", 12.5, "02/03/2025"),
        (2, "K03", "Cleo Marsh", "cleo@mail.org", "640", "Mer. Wool", 15.0, "2025/03/03"),
        (3, "K04", None, "dev@firm.co", None, "Nylon", 9.5, "2025-03-04"),
        (4, "K05", "Dev Patel", "dev@firm.co", "910", "Nyl", 9000.0, None),
        (5, "K06", "Eve Lund", "eve@mail.com", "1100", "Linen", 14.0, "Mar 6, 2025"),
        (6, "K06", "Eve Lund", "eve@mail.com", "1100", "Linen", 14.0, "Mar 6, 2025"),
        (7, "K08", "Finn Ode", "no-address", "n.a.", "Flax", -40.0, "not a date"),
    ]
    names = ["row_index", "Cust ID", "Cust Name", "Eml", "Ctn Wgt", "Material", "Txn Amt", "Dt Joined"]
    schema = ", ".join(
        f"`{n}` {'bigint' if n == 'row_index' else 'double' if n == 'Txn Amt' else 'string'}" for n in names
    )
    return spark.createDataFrame(rows, schema)
