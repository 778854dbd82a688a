from datetime import date, timedelta

import pytest
from helpers import at, kafka_frame, landed_at

from tidemark.plans import sweep
from tidemark.plans.publish import Publisher
from tidemark.schemas import LANDING_DATE

D1, D2 = date(2024, 5, 1), date(2024, 5, 2)
NOW = timedelta(0)


class Crashing(Publisher):
    def _validate(self, *args):
        raise OSError("storage went away")


def test_only_what_crashes_left_is_listed_and_removed(spark, tmp_path):
    root = str(tmp_path / "landing")
    for day in (1, 2):
        landed_at(kafka_frame(spark, 30, start=30 * day).repartition(6), root, at(day))
    made = lambda kind: kind(spark, "orders", root, str(tmp_path / "compacted"), str(tmp_path / "ledger"))
    job = made(Publisher)
    assert sweep.orphan_runs(job, NOW).count() == 0  # nothing written yet
    with pytest.raises(OSError):
        made(Crashing).publish([D1, D2])
    job.publish([D1, D2])
    before = sorted(r.offset for r in job.published().collect())
    left = sweep.orphan_runs(job, NOW).collect()
    # Both dates together, then each alone.
    assert sorted(r[LANDING_DATE] for r in left) == [D1, D1, D2, D2]
    assert all(r.files == 1 and r.bytes > 0 for r in left)
    assert not {r.run_id for r in left} & {r.run_id for r in job.in_force().collect()}
    assert sweep.orphan_runs(job).count() == 0  # too young
    assert len(sweep.remove(job, left)) == 4
    assert sweep.orphan_runs(job, NOW).count() == 0
    assert sorted(r.offset for r in job.published(verify=True).collect()) == before == list(range(30, 90))
