import pytest

from lodestack.functions.checks import front_door_fault, stamp, watch_fault


@pytest.mark.parametrize(
    ("url", "fault"),
    [(None, "is not set"), ("https://x.gov/", None), ("ftp://x.gov", "is not a URL"), ("https://", "has no host"), ("http://0x7f.1", "is an address, not a name"), ("http://[::1]/", "is an address, not a name"), ("https://docs.example.org", "is a reserved name"), ("https://{{name}}.gov", "still has a template marker")],
)
def test_front_door(url, fault):
    assert front_door_fault(url) == fault


def test_template_may_keep_its_marker():
    assert front_door_fault("https://{{name}}.gov", instantiated=False) is None


@pytest.mark.parametrize("watch", [None, [], "a", [1], ["a[].b[]"], ["a[0]"], ["a..b"], ["[]"]])
def test_refused_watches(watch):
    assert watch_fault(watch, "json")


def test_watches():
    assert watch_fault(["a.b", "c[].d"], "json") is None and watch_fault(["a"], "html")


def test_stamp():
    text = "---\nlast_verified: ''\nverified_by: ''\n---\n"
    assert "last_verified: 2024-01-01\nverified_by: me" in stamp(text, "me", "2024-01-01", True)
    with pytest.raises(ValueError):
        stamp(text, "me", "2024-01-01", False)
    with pytest.raises(ValueError):
        stamp("---\n---\n", "me", "2024-01-01", True)
