"""Text in, Spark SQL out; refusals by message."""

import pytest

from stratalake.plans.tsql.lexer import TSqlError, tokens
from stratalake.plans.tsql.parser import Parser, parse
from stratalake.plans.tsql.render import Context, Renderer

GOLDEN = [
    ("SELECT a FROM dbo.t", "SELECT `a` FROM `t` AS `t`"),
    ("SELECT [a b] AS 'x y' FROM [t]", "SELECT `a b` AS `x y` FROM `t` AS `t`"),
    ("SELECT TOP 3 a FROM t ORDER BY a DESC", "SELECT `a` FROM `t` AS `t` ORDER BY `a` DESC NULLS LAST LIMIT 3"),
    ("SELECT a FROM t ORDER BY a OFFSET 5 ROWS FETCH NEXT 2 ROWS ONLY", "SELECT `a` FROM `t` AS `t` ORDER BY `a` ASC NULLS LAST LIMIT 2 OFFSET 5"),
    ("SELECT ISNULL(a, 0), LEN(b) FROM t", "SELECT coalesce(`a`, 0) AS `isnull`, length(rtrim(`b`)) AS `len` FROM `t` AS `t`"),
    ("SELECT 'a' + b FROM t", "SELECT ('a' || `b`) FROM `t` AS `t`"),
    ("SELECT COUNT(*) FROM t WITH (NOLOCK)", "SELECT CAST(count(*) AS INT) AS `count` FROM `t` AS `t`"),
    ("SELECT x = 1, y FROM t WHERE NOT a IN (1, 2)", "SELECT 1 AS `x`, `y` FROM `t` AS `t` WHERE NOT (`a` IN (1, 2))"),
    ("SELECT N'it''s', 0xAB", "SELECT 'it''s', X'AB'"),
    ("SELECT CAST(a AS nvarchar(10)), CAST(b AS decimal) FROM t", "SELECT CAST(`a` AS STRING), CAST(`b` AS DECIMAL(18,0)) FROM `t` AS `t`"),
    ("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3", "SELECT 1 UNION (SELECT 2 INTERSECT SELECT 3)"),
    ("SELECT GETDATE()", "SELECT localtimestamp() AS `getdate`"),
]
REFUSED = [
    "CREATE TABLE t (a int)", "DECLARE @a int", "EXEC('select 1')", "SELECT 1 a INTO", "SELECT a FROM t CROSS APPLY f(a)", "DROP TABLE t", "SELECT SUM(a) OVER (ORDER BY b ROWS 1 PRECEDING) FROM t",
    "SELECT a FROM t GROUP BY GROUPING SETS ((a))", "SET @a = 1", "MERGE t USING s ON t.a = s.a WHEN NOT MATCHED THEN INSERT (a) VALUES (1);", "INSERT INTO t OUTPUT INSERTED.* VALUES (1)",
    "SELECT TOP 1 a FROM t ORDER BY a OFFSET 1 ROWS FETCH NEXT 1 ROWS ONLY", "SELECT 'open",
]


@pytest.mark.parametrize(("text", "want"), GOLDEN)
def test_golden(text, want):
    assert Renderer(Context()).query(parse(text)[0].query) == want


@pytest.mark.parametrize("text", REFUSED)
def test_refused(text):
    with pytest.raises(TSqlError):
        parse(text)


def test_tokens_and_comments():
    assert [t.text for t in tokens("a -- x\n /* b /* c */ */ [d]]e] 'f''g' @@h #i 1.5e3")][:-1] == ["a", "d]e", "f'g", "@@h", "#i", "1.5e3"]


def test_nested_join_binds_its_own_on():
    q = parse("SELECT 1 FROM a LEFT JOIN b JOIN c ON b.x = c.x ON a.y = b.y")[0].query
    assert q.body.source.right.kind == "join" and q.body.source.type == "LEFT"


def test_unknown_parameter_and_function():
    with pytest.raises(TSqlError, match="must declare"):
        Renderer(Context()).expr(Parser("@x + 1").expr())
    with pytest.raises(TSqlError, match="not a recognized"):
        Renderer(Context()).expr(Parser("STUFF('a', 1, 1, 'b')").expr())
