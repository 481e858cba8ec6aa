"""Statements against a session: queries on the employee fixtures, changes, definitions, transactions, SHOW."""

import datetime

import pytest

from larkspur.session import Session
from larkspur.sql.lexer import SQLError

EMPLOYEES = [("Alice", "Engineering", 80000.0, "2020-01-15", 28), ("Bob", "Sales", 60000.0, "2019-03-20", 32), ("Charlie", "Engineering", 90000.0, "2018-06-10", 35), ("Diana", "HR", 55000.0, "2021-02-01", 26), ("Eve", "Sales", 65000.0, "2020-08-15", 29), ("Frank", "Engineering", 95000.0, "2017-11-05", 40), ("Grace", "HR", 58000.0, "2022-01-10", 24)]


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.sql("CREATE DATABASE app")
    s.sql("USE app")
    return s


def rows(s, text, params=None):
    return [tuple(r) for r in s.sql(text, params).collect()]


@pytest.fixture
def staff(s):
    s.sql("CREATE TABLE employees (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(100) NOT NULL, department VARCHAR(50), salary DECIMAL(10,2), hire_date DATE, age INT)")
    values = ", ".join(f"('{n}', '{d}', {p}, '{h}', {a})" for n, d, p, h, a in EMPLOYEES)
    got = s.sql(f"INSERT INTO employees (name, department, salary, hire_date, age) VALUES {values}")
    assert (got.affected, got.last_insert_id) == (7, 1)
    return s


def test_queries(staff):
    s = staff
    assert len(rows(s, "SELECT * FROM employees")) == 7
    assert rows(s, "SELECT name FROM employees WHERE department = 'Engineering' AND salary > 85000 ORDER BY name") == [("Charlie",), ("Frank",)]
    assert rows(s, "SELECT name FROM employees ORDER BY salary DESC LIMIT 2 OFFSET 3") == [("Eve",), ("Bob",)]
    assert rows(s, "SELECT department, COUNT(*) n FROM employees GROUP BY department HAVING AVG(salary) > 60000 ORDER BY 1") == [("Engineering", 3), ("Sales", 2)]
    assert rows(s, "SELECT name FROM employees WHERE name LIKE 'A%' OR age IN (24) OR age BETWEEN 39 AND 41 ORDER BY age") == [("Grace",), ("Alice",), ("Frank",)]
    assert rows(s, "SELECT COUNT(*), MAX(age), MIN(hire_date) FROM employees WHERE age > 100") == [(0, None, None)]
    assert rows(s, "SELECT 1/0, 7 DIV 0, 5 % 0, 7 / 2") == [(None, None, None, 3.5)]
    assert rows(s, "SELECT NULL = NULL, NULL <=> NULL, FALSE AND NULL, FALSE || 1 > 0") == [(None, True, False, True)]
    assert rows(s, "SELECT name FROM employees WHERE age > ? AND department = ?", [30, "Sales"]) == [("Bob",)]
    assert s.prepare("q", "SELECT COUNT(*) FROM employees WHERE name <> '?' AND age < ?") == 1
    assert s.execute("q", [30]).first()[0] == 4
    with pytest.raises(SQLError):
        s.execute("q", [])


def test_any_and_all_with_nulls(s):
    s.register("e", s.spark.createDataFrame([], "x int"))
    s.register("n", s.spark.createDataFrame([(1,), (None,)], "x int"))
    assert rows(s, "SELECT 2 > ALL (SELECT x FROM e), 2 > ANY (SELECT x FROM e), 2 > ALL (SELECT x FROM n), 2 > ANY (SELECT x FROM n), 0 > ALL (SELECT x FROM n), 0 > ANY (SELECT x FROM n)") == [(True, False, None, True, False, None)]


def test_changes(staff):
    s = staff
    assert s.sql("UPDATE employees SET salary = salary * 2, age = age + 1 WHERE name = 'Bob'").affected == 1
    assert rows(s, "SELECT salary, age FROM employees WHERE name = 'Bob'") == [(120000, 33)]
    assert s.sql("UPDATE employees SET age = 0 ORDER BY age DESC LIMIT 2").affected == 2
    assert rows(s, "SELECT name FROM employees WHERE age = 0 ORDER BY name") == [("Charlie",), ("Frank",)]
    assert s.sql("DELETE FROM employees WHERE salary < (SELECT AVG(salary) FROM employees)").affected == 4
    assert s.sql("DELETE FROM employees").affected == 3
    assert s.sql("INSERT INTO employees (name) VALUES ('Zed')").last_insert_id == 8
    s.sql("TRUNCATE TABLE employees")
    assert s.sql("INSERT INTO employees (name) VALUES ('Zed')").last_insert_id == 1


def test_keys(s):
    s.sql("CREATE TABLE p (id INT PRIMARY KEY, name VARCHAR(10) NOT NULL, stock INT DEFAULT 5, state ENUM('on','off') DEFAULT 'on', UNIQUE KEY n (name))")
    s.sql("INSERT INTO p (id, name) VALUES (1, 'a'), (2, 'b')")
    for bad in ("INSERT INTO p (id, name) VALUES (1, 'c')", "INSERT INTO p (id, name) VALUES (3, 'a')", "INSERT INTO p (id, name) VALUES (3, NULL)", "INSERT INTO p (id) VALUES (4)", "INSERT INTO p (id, name) VALUES (5, '12345678901')", "INSERT INTO p VALUES (6, 'x', 1, 'maybe')", "INSERT INTO p VALUES (1)", "UPDATE p SET id = 1"):
        with pytest.raises(SQLError):
            s.sql(bad)
    assert s.sql("INSERT IGNORE INTO p (id, name) VALUES (1, 'z'), (3, 'c'), (3, 'd')").affected == 1
    s.sql("REPLACE INTO p (id, name, stock) VALUES (2, 'bb', 9), (4, 'd', 9)")
    s.sql("INSERT INTO p (id, name, stock) VALUES (1, 'q', 7), (5, 'e', 1) ON DUPLICATE KEY UPDATE stock = stock + VALUES(stock)")
    assert sorted(rows(s, "SELECT id, name, stock FROM p")) == [(1, "a", 12), (2, "bb", 9), (3, "c", 5), (4, "d", 9), (5, "e", 1)]


def test_joined_changes(s):
    s.sql("CREATE TABLE a (i INT, v INT)")
    s.sql("CREATE TABLE b (i INT, w INT)")
    s.sql("INSERT INTO a VALUES (1, 0), (2, 0), (3, 0)")
    s.sql("INSERT INTO b VALUES (1, 10), (3, 30)")
    assert s.sql("UPDATE a JOIN b ON a.i = b.i SET a.v = b.w").affected == 2
    assert sorted(rows(s, "SELECT * FROM a")) == [(1, 10), (2, 0), (3, 30)]
    assert s.sql("DELETE a FROM a JOIN b ON a.i = b.i WHERE b.w > 10").affected == 1
    assert sorted(rows(s, "SELECT i FROM a")) == [(1,), (2,)]


def test_transactions(staff):
    s = staff
    s.sql("BEGIN")
    s.sql("DELETE FROM employees WHERE id = 1")
    s.sql("SAVEPOINT x")
    s.sql("DELETE FROM employees")
    s.sql("ROLLBACK TO x")
    assert s.sql("SELECT * FROM employees").count() == 6
    s.sql("ROLLBACK")
    assert s.sql("SELECT * FROM employees").count() == 7
    with pytest.raises(SQLError):
        s.sql("ROLLBACK TO nowhere")


def test_definitions_do_not_leak(staff):
    s = staff
    s.sql("CREATE TABLE other LIKE employees")
    s.sql("ALTER TABLE other ADD COLUMN c INT, RENAME COLUMN name TO called")
    assert "c" not in s.sql("SELECT * FROM employees").columns and rows(s, "DESC employees")[1][0] == "name"
    s.sql("BEGIN")
    s.sql("ALTER TABLE employees DROP COLUMN age, ADD INDEX i (name)")
    s.sql("ROLLBACK")
    assert "age" in [r[0] for r in rows(s, "DESC employees")] and {r[2] for r in rows(s, "SHOW INDEX FROM employees")} == {"PRIMARY"}


def test_definitions_and_show(staff):
    s = staff
    assert [r[:4] for r in rows(s, "DESC employees")][:2] == [("id", "int", "NO", "PRI"), ("name", "varchar(100)", "NO", "")]
    assert "AUTO_INCREMENT" in rows(s, "SHOW CREATE TABLE employees")[0][1] and rows(s, "SHOW TABLES") == [("employees",)]
    s.sql("ALTER TABLE employees ADD COLUMN note TEXT AFTER name, DROP COLUMN age, CHANGE department dept VARCHAR(60)")
    assert s.sql("SELECT * FROM employees").columns == ["id", "name", "note", "dept", "salary", "hire_date"]
    s.sql("CREATE INDEX by_dept ON employees (dept)")
    assert {r[2] for r in rows(s, "SHOW INDEX FROM employees")} == {"PRIMARY", "by_dept"}
    s.sql("RENAME TABLE employees TO staff")
    s.sql("CREATE VIEW v AS SELECT dept, COUNT(*) AS n FROM staff GROUP BY dept")
    assert sorted(rows(s, "SELECT * FROM v WHERE n > 2")) == [("Engineering", 3)]
    assert rows(s, "SELECT COUNT(*) FROM information_schema.COLUMNS WHERE TABLE_NAME = 'staff'") == [(6,)]
    s.sql("DROP TABLE staff")
    for bad in ("SELECT * FROM app.staff", "DROP TABLE staff", "CREATE TABLE z (a INT, a INT)", "DROP DATABASE mysql", "USE nowhere"):
        with pytest.raises(Exception):
            s.sql(bad)
    s.sql("DROP TABLE IF EXISTS staff")


def test_variables(s):
    s.sql("SET autocommit = 0, @x = 5")
    assert rows(s, "SELECT @@autocommit, @x, DATABASE()") == [(0, "5", "app")]
    s.sql("SET version = 'x'")
    assert rows(s, "SELECT @@version") == [("8.0.32",)] and len(rows(s, "SHOW VARIABLES")) == 56
    assert rows(s, "SHOW VARIABLES LIKE 'TX\\_iso%'") == [("tx_isolation", "REPEATABLE-READ")]
    s.sql("SET SESSION TRANSACTION ISOLATION LEVEL READ COMMITTED, READ ONLY")
    assert rows(s, "SELECT @@tx_isolation, @@tx_read_only") == [("READ-COMMITTED", 1)]
    assert len(rows(s, "SHOW ENGINES")) == 7 and len(rows(s, "SHOW DATABASES")) == 6 and rows(s, "SHOW WARNINGS") == []


def test_functions(s):
    got = rows(s, "SELECT CONCAT('a', NULL), SUBSTRING('hello', 0), SUBSTRING('hello', -2), IF(NULL, 1, 2), CAST('x' AS SIGNED), DATE '2020-01-31' + INTERVAL 1 MONTH, GREATEST(1, NULL), TRUNCATE(-1.57, 1), CHAR_LENGTH('é'), LENGTH('é')")[0]
    assert got[:5] == (None, "", "lo", 2, None) and got[5] == datetime.date(2020, 2, 29) and got[6] is None and float(got[7]) == -1.5 and got[8:] == (1, 2)
    s.register_function("twice", lambda x: x * 2, "int")
    assert rows(s, "SELECT TWICE(21)") == [(42,)]
