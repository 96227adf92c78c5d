"""Files as other programs write them, and values that aren't what their place asks for."""

import pytest
from pyspark.sql import functions as F

from runloom.sources import osb, storyboard

REAL = """osu file format v14
[Variables]
$bg="sb/bg.png"
$b=0

[Events]
//Background and Video events
0,0,"bg.jpg",0,0
Video,-500,"clip.avi"
 F,0,0,100,0,1
2,1000,2000
//Storyboard Layer 0 (Background)
Sprite,Background,Centre,$bg,320,240
 F,$b,0,,1
 L,100,2
  MX,0,0,50,1,2
 M,0,10,20,1,2,3,4
4,3,1,"plain.png",1,2
_S,0,0,,0.5
6,4,0,"walk.png",5,6,4,50
Animation,Pass,TopLeft,"run.png",7,8,9,60,1
 P,0,0,0,A
Sample,500,0,"hit.wav",70
5,500,0,"hit.wav",70
3,100,163,162,255
[Colours]
Combo1 : 1,2,3
"""


def read(spark, text):
    return osb.read(spark.createDataFrame([("d", text)], "doc string, value string"))


def test_a_file_with_other_events(spark):
    objects, commands = read(spark, REAL.replace("\n", "\r\n"))
    got = [(r.z, r.type, r.layer, r.layer_ord, r.origin, r.path, r.x, r.frame_count, r.loop_type) for r in objects.orderBy("z").collect()]
    assert got == [
        (13, "Sprite", "Background", 0, "Centre", "sb/bg.png", 320, None, None), (18, "Sprite", "Foreground", 3, "Centre", "plain.png", 1, None, None),
        (20, "Animation", "Overlay", 4, "TopLeft", "walk.png", 5, 4, "LoopForever"), (21, "Animation", "Pass", 2, "TopLeft", "run.png", 7, 9, "LoopOnce"),
    ]
    c = [(r.object, r.kind, r.easing, r.parent) for r in commands.orderBy("object", "place").collect()]
    assert c == [(13, "Fade", 0, 13), (13, "MoveX", 0, 15), (13, "MoveX", 0, 13), (13, "MoveY", 0, 13), (13, "Loop", None, 13), (18, "Scale", 0, 18), (21, "Additive", 0, 21)]


@pytest.mark.parametrize("head, line, want", [
    ('Sprite,Nowhere,Centre,"a",0,0', None, "line 1: expected layer, got"), ('Sprite,Pass,Nothing,"a",0,0', None, "line 1: expected origin"), ('Sprite,Pass,Centre,"a",x,0', None, "line 1: expected number, got \"x\""),
    ('Animation,Pass,Centre,"a",0,0,1.5,9,LoopOnce', None, "line 1: expected integer"), ('Animation,Pass,Centre,"a",0,0,1,9,Twice', None, "line 1: expected loop type"), ('AnimationVideo,Pass,Centre,"a",0,0,,x', None, "line 1: expected number"),
    (None, "F,0,0,x,1", "line 2: expected number"), (None, "F,z,0,1,1", "line 2: expected integer"), (None, "C,0,0,1,1,2,256", "line 2: expected byte, got \"256\""), (None, "C,0,0,1,1,2,3,4", "line 2: wrong number"),
    (None, "V,0,0,1,1,2,3", "line 2: wrong number"), (None, "P,0,0,1,Q", "line 2: expected flag"), (None, "L,0,two", "line 2: expected integer"), (None, "T,Hit,0,1,x", "line 2: expected integer"),
])
def test_errors_say_what_and_where(spark, head, line, want):
    text = (head or 'Sprite,Background,Centre,"a",0,0') + ("\n " + line if line else "")
    lines = storyboard.split_lines(spark.createDataFrame([("d", text)], "doc string, value string"))
    with pytest.raises(Exception, match=want):
        storyboard.objects(storyboard.checked(storyboard.parse(lines))).collect()
        storyboard.commands(storyboard.checked(storyboard.parse(lines))).collect()


def test_blank_ends_and_tails_are_fine(spark):
    text = 'AnimationVideo,Pass,Centre,"a",0,0,,24\n F,0,0,,1\n T,Hit,0,9\n  F,0,0,1,1\n'
    lines = storyboard.split_lines(spark.createDataFrame([("d", text)], "doc string, value string"))
    assert storyboard.commands(storyboard.checked(storyboard.parse(lines))).count() == 3


def test_variables_are_found_without_a_second_pass(spark):
    text = "[Variables]\n$a=1\n$ab=320\n[Events]\nSprite,Background,Centre,\"p.png\",$ab,$a\n F,0,$a,$ab,0,1\n"
    files = spark.createDataFrame([("d", text), ("e", text.replace("$ab=320", "$ab=9"))], "doc string, value string")
    events = osb.events(files)
    assert "Join" not in events._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc, r.line) for r in events.collect()} == {
        (d, x) for d, v in (("d", 320), ("e", 9)) for x in (f'Sprite,Background,Centre,"p.png",{v},1', f" F,0,1,{v},0,1")
    }
    split = lambda s: spark.range(1).select(storyboard.split_fields(F.lit(s))).first()[0]
    assert split("a,b,,") == ["a", "b", "", ""] and split(" F,0,,1") == [" F", "0", "", "1"] and split('x,"a,b') == ["x", "a,b"]
