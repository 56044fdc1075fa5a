import pytest

from pagewright.cli import main
from pagewright.sources.service import check_models, device, form_fields


def test_form_fields():
    plain = {"return_md": "true", "response_format_zip": "false"}
    assert form_fields({}) == plain and form_fields({"enable_ocr": True, "device": "", "model_dir": None}) == plain
    got = form_fields({"enable_ocr": False, "device": "cpu", "download_dir": "/d", "extra_options": {"lang": "en", "none": None, "depth": 2, "device": "cuda"}})
    assert got == plain | {"method": "txt", "device": "cuda", "download_dir": "/d", "lang": "en", "depth": "2"}


def test_device():
    assert [device("auto", True), device("auto", False), device("cuda", True), device("cpu", False), device("mps", False)] == ["cuda", "cpu", "cuda", "cpu", "mps"]
    with pytest.raises(RuntimeError, match="cuda .* not available"):
        device("cuda", False)


def test_models(tmp_path):
    check_models({})
    with pytest.raises(ValueError, match="policy"):
        check_models({"model_policy": "other"})
    need = {"model_policy": "require_existing"}
    for config in ({"model_dir": str(tmp_path / "none")}, {"model_dir": str(tmp_path)}, {"download_dir": str(tmp_path)}):
        with pytest.raises(RuntimeError, match="exist"):
            check_models(need | config)
    (tmp_path / ".mineru").mkdir()
    check_models(need | {"download_dir": str(tmp_path)})
    check_models(need | {"model_dir": str(tmp_path)})
    check_models(need, home=str(tmp_path))


def test_the_command_line_refuses_what_a_service_would(spark, tmp_path, capsys):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    parse = ["parse", str(tmp_path / "x.pdf"), "--engine", "mineru"]
    assert main([*parse, "--model-policy", "require_existing", "--model-dir", str(tmp_path / "none")], spark) == 1 and "missing or empty" in capsys.readouterr().err
    assert main([*parse, "--device", "cuda"], spark) == 1 and "not available" in capsys.readouterr().err
    assert main(parse, spark) == 1 and "not implemented" in capsys.readouterr().err
