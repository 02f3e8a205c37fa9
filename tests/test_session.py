import os

import pytest

from tessitura import session


def test_written_tables_go_with_their_block(spark):
    with session.written_tables(spark) as own:
        df = session.materialize(spark.range(10), "numbers")
        assert df.count() == 10
        (path,) = [p.removeprefix("file:") for p in own]
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


def test_a_cluster_must_name_the_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session(), "numbers")
