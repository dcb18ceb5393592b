import pytest

from ionolake import config
from ionolake.operators import filters
from ionolake.operators.correction import Settings

pytest.importorskip("yaml")


def test_folder_is_merged_in_order_of_name(tmp_path):
    (tmp_path / "a.yaml").write_text("correction: {window: 30, min_snr: {cw: 4}}\nx: [1]\n")
    (tmp_path / "b.yml").write_text("correction: {min_reports: 5, max_distance: 0}\nx: [2]\n")
    c = config.load(str(tmp_path))
    assert c["x"] == [2] and config.correction_settings(c) == Settings(window=30, min_reports=5, min_snr=(("CW", 4),))
    with pytest.raises(ValueError):
        config.correction_settings({"correction": {"windw": 1}})


def test_filters_survive_a_file(tmp_path):
    f = filters.Filter(call="K1ABC")
    for line in ("PASS DXZONE 3,4", "REJECT MODE FT8", "REJECT BEACON", "REJECT DXCONT ALL"):
        f, _ = filters.command(f, line)
    config.save_filter(f, str(tmp_path / "f.yaml"))
    assert config.load_filter(str(tmp_path / "f.yaml")) == f
    (tmp_path / "empty.yaml").write_text("rules: {band: {allow: [], block: []}}")
    assert config.load_filter(str(tmp_path / "empty.yaml")).rule("BAND") == filters.Rule()
