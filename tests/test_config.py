import json

import pytest

from histolith.functions import vocabulary as V
from histolith.model import Config


def test_extra_adds_bare_replaces_weights_merge(tmp_path, capsys):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"extra_stopwords": ["zz"], "generic_basenames": ["only"], "weights": {"schema": 9}, "source_roots": ["b", "a"], "extra_source_roots": ["c"], "cluster_capp": 3}))
    c = Config.from_file(str(f))
    assert c.stopwords == frozenset(V.STOPWORDS) | {"zz"} and c.generic_basenames == {"only"}
    assert c.weights["schema"] == 9 and c.weights["new_src"] == 3 and c.roots == ["a", "b", "c"]
    assert "did you mean 'cluster_cap'" in capsys.readouterr().err
    assert Config.from_file(None) == Config() and Config().weights == V.WEIGHTS


def test_frozen():
    with pytest.raises(Exception):
        Config().cluster_cap = 3


def test_depth_is_measured_from_the_module():
    assert Config().first_depth == 2 and Config(module_prefix="services/findings").first_depth == 3
