"""The entry module with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)


def names(before: str = "") -> set[str]:
    code = f"import sys; sys.path.insert(0, {ROOT!r}); {before}\nimport __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-B", "-c", code], capture_output=True, text=True, check=True).stdout.split("\n")
    assert set(out[1].split()) <= set(out[0].split())
    return set(out[0].split())


def test_own_queries_do_not_need_it():
    without = names("sys.modules['sphaera.llm'] = None; sys.modules['corpus_pipeline'] = None")
    assert "t8_fit" in without and "pipeline" not in without
    assert not [n for n in without if n.startswith("op")]
    assert names("sys.modules['sphaera.llm'] = None") == without
    assert without <= names()


def test_other_missing_modules_are_errors():
    with pytest.raises(subprocess.CalledProcessError):
        names("sys.modules['sphaera.plans.catalog'] = None")


def test_cluster_sessions_must_name_a_shared_folder():
    from types import SimpleNamespace as N

    from sphaera.session import checkpoint_root

    def session(master, conf):
        made = []
        sc = N(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        return N(sparkContext=sc, conf=N(get=lambda k, d=None: conf.get(k, d)))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            checkpoint_root(session(master, {}))
        assert checkpoint_root(session(master, {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert checkpoint_root(session(master, {}))
