"""Both engines must make the same cells of a view, also of values the given tables do not hold."""

import duckdb

from checks.compare import compare
from checks.scalars import lenient_number_events
from checks.registry import ORACLES


def test_events_with_more_than_two_decimals_round_alike(spark, tmp_path):
    con = duckdb.connect()
    path = tmp_path / "events.parquet"
    # Ties and near ties of the third decimal, negative and large values, a missing one.
    values = "SELECT i AS event_id, CASE WHEN i = 3999 THEN NULL WHEN i % 4 = 3 THEN -i * 0.005 WHEN i % 4 = 2 THEN i * 1234.5675 ELSE i * 0.005 END::DOUBLE AS value FROM range(4000) t(i)"
    con.execute(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' AS ts, event_id AS user_id, 'view' AS event_type, value FROM ({values})) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    assert compare(spark, con, str(tmp_path), lenient_number_events, ORACLES["lenient_number_events"]) is None
