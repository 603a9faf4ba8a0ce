import pytest

from tidemark import session


class Fake:
    """The two things ``workspace`` asks a session for."""

    def __init__(self, folder, master):
        self.conf = {} if folder is None else {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_comes_from_the_session():
    path = session.workspace(Fake("hdfs://lake/tmp/", "yarn"), "x")
    assert path.startswith("hdfs://lake/tmp/tidemark/x-")
    assert path != session.workspace(Fake("hdfs://lake/tmp/", "yarn"), "x")


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.workspace(Fake(None, "yarn"), "x")


def test_a_local_session_may_use_its_own_folder():
    assert "tidemark-x-" in session.workspace(Fake(None, "local[2]"), "x")
