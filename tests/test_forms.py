"""Extractors of declarative formats."""

import struct
import zlib

import pytest

from loomgraph.sources import extract, forms


def found(fn, path, text):
    n, e, c = fn(path, text)
    return {r[0]: r[1] for r in n}, {r[:3] for r in e}, set(c)


def test_solution():
    text = """
Project("{FAE}") = "App", "src\\App\\App.csproj", "{AA-1}"
	ProjectSection(ProjectDependencies) = postProject
		{bb-2} = {BB-2}
		{AA-1} = {AA-1}
		{ZZ-9} = {ZZ-9}
	EndProjectSection
EndProject
Project("{FAE}") = "Lib", "src\\Lib\\Lib.csproj", "{BB-2}"
EndProject
"""
    n, e, _ = found(forms.extract_sln, "all.sln", text)
    assert n == {"all": "all.sln", "src_app_app": "App", "src_lib_lib": "Lib"}
    assert e == {("all", "src_app_app", "contains"), ("all", "src_lib_lib", "contains"), ("src_app_app", "src_lib_lib", "imports")}


def test_blade():
    n, e, _ = found(forms.extract_blade, "v/home.blade.php", "@include('parts.nav')\n<livewire:user-list />\n<b wire:click=\"save\">@include('parts.nav')")
    assert e == {("v_home_blade", "parts_nav", "includes"), ("v_home_blade", "user_list", "uses_component"), ("v_home_blade", "save", "binds_method")}
    assert n["parts_nav"] == "parts.nav"


def test_razor():
    text = '@page "/x/{id}"\n@using A.B\n@inject Db db\n@inherits Base\n@model M\n<Div></Div><Grid />\n@code {\n  private async Task<int> Load(int x) { if (a) { } return 1; }\n}\npublic void Outside() {}'
    n, e, _ = found(forms.extract_razor, "p/x.razor", text)
    assert e == {
        ("p_x", "route_x_id", "references"), ("p_x", "a_b", "imports"), ("p_x", "db", "imports"), ("p_x", "base", "inherits"),
        ("p_x", "m", "references"), ("p_x", "grid", "calls"), ("p_x", "p_x_load", "contains"),
    }
    assert n["route_x_id"] == "route:/x/{id}"


def test_form():
    text = "object Form1: TForm1\n  OnShow = FormShow\n  object B: TButton\n    OnClick = BClick\n  end\n  object C: TPanel\n  end\nend\n"
    _, e, _ = found(forms.extract_form, "f.lfm", text)
    assert e == {("f", "f_tform1", "contains"), ("f_tform1", "f_formshow", "references"), ("f_tform1", "f_tbutton", "contains"), ("f_tbutton", "f_bclick", "references"), ("f_tform1", "f_tpanel", "contains")}
    with pytest.raises(ValueError):
        forms.extract_form("f.dfm", b"\xff\x0a\x00".decode("utf-8", "replace"))


def test_module_manifest():
    text = "@{\n RootModule = 'Mine.psm1'\n # NestedModules = 'gone'\n NestedModules = @('A.psm1', 'sub\\B.ps1')\n RequiredModules = @('PSReadLine',\n  @{ ModuleName = 'Pester'; ModuleVersion = '5.0' })\n Author = 'x'\n}"
    _, e, _ = found(forms.extract_module_manifest, "m/Mod.psd1", text)
    assert {d for _, d, r in e if r == "imports_from"} == {"mine", "a", "b", "psreadline", "pester"}


def png(kind, payload):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(payload)) + kind + payload + b"\0\0\0\0"


def test_icons():
    text = b'# BEGIN DMI\nversion = 4.0\nstate = "open"\n\tdirs = 1\nstate = "shut"\nstate = "open"\nstate = ""\n'
    for data in (png(b"tEXt", b"Description\0" + text), png(b"zTXt", b"Description\0\0" + zlib.compress(text))):
        n, e, _ = found(forms.extract_icons, "i/door.dmi", data)
        assert sorted(n.values()) == ['"open"', '"shut"', "door.dmi"] and len(e) == 2
    assert found(forms.extract_icons, "i/door.dmi", b"no picture")[1] == set()


def test_map():
    text = '"aa" = (/turf/floor{name = "a, /b(c"; dir = 4},/area/hall)\n"ab" = (\n/obj/door,\n/turf/floor)\n(1,1,1) = {"\naaab\n/not/this\n"}\n'
    assert {d for _, d, _ in found(forms.extract_map, "m.dmm", text)[1]} == {"turf_floor", "area_hall", "obj_door"}


def test_interface():
    n, e, _ = found(forms.extract_interface, "s.dmf", 'window "main"\n\telem "map"\n\t\ttype = MAP\n\t\tpos = 0,0\n\telem "out"\nwindow "other"\n')
    assert e == {("s", "s_window_main", "contains"), ("s_window_main", "s_window_main_elem_map", "contains"), ("s_window_main", "s_window_main_elem_out", "contains"), ("s", "s_window_other", "contains")}
    assert n["s_window_main_elem_map"] == 'elem "map" [MAP]'


def test_dream():
    text = '#include "code/base.dm"\n/mob/player\n\tvar/hp = 3\n\tproc/hit(n)\n\t\tif(n)\n\t\t\tlog_it("x(y)")\n\t\tnew /obj/blood(src)\n\tLogin()\n\t\tsrc.hit(1) // call()\n/proc/log_it(t)\n\treturn t\n'
    n, e, c = found(forms.extract_dream, "g.dm", text)
    assert e == {
        ("g", "code_base", "imports_from"), ("g", "mob_player", "contains"), ("mob_player", "mob_player_hit", "method"), ("mob_player_hit", "obj_blood", "instantiates"),
        ("mob_player", "mob_player_login", "method"), ("g", "g_log_it", "contains"),
    }
    assert c == {("mob_player_hit", "log_it", False), ("mob_player_login", "hit", True)}


@pytest.mark.parametrize("suffix", ["sln", "blade.php", "razor", "lfm", "dfm", "psd1", "dmm", "dmf", "dm"])
@pytest.mark.parametrize("text", ["", "\n\n", "x" * 100_000, "{" * 5000 + "(" * 5000 + '"' * 3 + "end\n" * 50, '@{ RequiredModules = @(', "state = \nobject : \n@code {"])
def test_nothing_to_find(suffix, text):
    n, e, _ = extract.REGISTRY[suffix](f"d/f.{suffix}", text)
    assert len(n) == 1 and not e


def test_by_suffix(spark):
    icons = png(b"tEXt", b'Description\0state = "s"\n')
    files = [("a.blade.php", "@include('x')", None), ("b.php", "<?php\nclass Y {}", None), ("c.dmi", "", bytearray(icons)), ("d.dmi", "", None), ("sln", "", None)]
    out = extract.extract(spark.createDataFrame(files, "path string, text string, content binary")).collect()
    got = {r["path"]: ([e["relation"] for e in r["edges"]], r["error"]) for r in out}
    assert got == {"a.blade.php": (["includes"], None), "b.php": (["contains"], None), "c.dmi": (["contains"], None), "d.dmi": ([], "ValueError: no content"), "sln": ([], None)}
