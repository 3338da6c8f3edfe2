"""Corpora shaped from the given tables.

A corpus is a base (a table or a join of tables) plus stages of select expressions written in the
SQL that Spark and the checking database share, so one definition serves both. This is only input
shaping: the operators work on whatever files, references or claims a user brings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import Tables


@dataclass(frozen=True)
class Corpus:
    source: str
    """FROM clause for the checking database."""
    frame: Callable[[Tables], DataFrame]
    stages: list[dict[str, str]] = field(default_factory=list)
    needs: tuple[str, ...] = ()

    def spark(self, tables: Tables) -> DataFrame:
        df = self.frame(tables)
        for stage in self.stages:
            df = df.selectExpr(*[e if n == e else f"{e} AS {n}" for n, e in stage.items()])
        return df

    def sql(self) -> str:
        query = f"(SELECT * FROM {self.source})"
        for stage in self.stages:
            items = ", ".join(e if n == e else f"{e} AS {n}" for n, e in stage.items())
            query = f"(SELECT {items} FROM {query})"
        return f"SELECT * FROM {query}"


def _template(text: str, **values: str) -> str:
    """SQL expression for ``text`` with ``<<name>>`` places filled by SQL expressions."""
    expr = "'" + text.strip("\n") + "'"
    for name, value in values.items():
        expr = f"replace({expr}, '<<{name}>>', {value})"
    return expr


def _places(t: Tables) -> DataFrame:
    # nation and region are lookup tables of fixed size (25 and 5 rows).
    return t.customer.join(
        F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))),
        F.col("c_nationkey") == F.col("n_nationkey"),
    )


_PLACES_SQL = (
    "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)

_TREE_DIR = """CASE k % 13 WHEN 0 THEN slug || '/src' WHEN 1 THEN slug || '/lib/core'
 WHEN 2 THEN slug || '/tests/unit' WHEN 3 THEN slug || '/node_modules/pkg'
 WHEN 4 THEN slug || '/vendor/dep' WHEN 5 THEN slug || '/docs' WHEN 6 THEN slug || '/Build/out'
 WHEN 7 THEN slug || '/app.egg-info' WHEN 8 THEN slug || '/cmd/tool'
 WHEN 9 THEN slug || '/third_party/x/node_modules' WHEN 10 THEN slug || '/examples/demo'
 WHEN 11 THEN slug || '/a/b/c' ELSE '' END"""
_TREE_NAME = """CASE k % 40 WHEN 0 THEN 'package-lock.json' WHEN 1 THEN 'README.md'
 WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'Makefile' WHEN 4 THEN 'main.go' WHEN 5 THEN 'index.ts'
 WHEN 6 THEN 'lib.min.js' WHEN 7 THEN 'api_pb2.py' WHEN 8 THEN 'package.json'
 WHEN 9 THEN 'requirements-dev.txt' WHEN 10 THEN 'logo.PNG' WHEN 11 THEN 'manage.py'
 WHEN 12 THEN 'DemoApplication.java' WHEN 13 THEN 'Dockerfile.prod' WHEN 14 THEN 'pyproject.toml'
 WHEN 15 THEN 'go.sum' ELSE 'file_' || CAST(k AS STRING) || CASE k % 23 WHEN 0 THEN '.py'
 WHEN 1 THEN '.js' WHEN 2 THEN '.css' WHEN 3 THEN '.ts' WHEN 4 THEN '.tsx' WHEN 5 THEN '.java'
 WHEN 6 THEN '.go' WHEN 7 THEN '.rb' WHEN 8 THEN '.rs' WHEN 9 THEN '.md' WHEN 10 THEN '.json'
 WHEN 11 THEN '.yaml' WHEN 12 THEN '.toml' WHEN 13 THEN '.txt' WHEN 14 THEN '.html'
 WHEN 15 THEN '.sql' WHEN 16 THEN '.sh' WHEN 17 THEN '.xyz' WHEN 18 THEN '.cfg'
 WHEN 19 THEN '.PY' WHEN 20 THEN '.h' WHEN 21 THEN '.cpp' ELSE '' END END"""
_TREE_TEXT = """CASE WHEN k % 29 = 0 THEN repeat('var a=1;', 200)
 WHEN k % 31 = 0 THEN 'bin' || chr(0) || 'x' WHEN k % 37 = 0 THEN repeat('short' || chr(10), 400)
 ELSE 'line of ' || c_name || chr(10) || 'second ' || c_mktsegment END"""

_PYTHON = """
import os
import json as js, sys
from . import sibling_<<k>>
from ..core.base import Base, helper as h
from pkg<<m>>.mod_<<k>> import thing

CONST = <<k>>

@decorator
def top_<<k>>(a,
        b=(1, 2)):
    "one line"
    return {"x": a}

class Model_<<k>>(Base):
    value = 1

    @property
    def prop(self):
        return "}"

    async def run(self):
        def inner():
            return 1
        return inner()

    class Meta:
        ordering = []

<<extra>>
tail = 1
"""
_TYPESCRIPT = """
import React from "react";
import { a, b } from "./mod_<<k>>";
export * from "../w<<m>>/other";
const fs = require("fs");

// function hidden() { }
export interface Shape_<<k>> {
  name: string;
}
export type Id = string;
enum Color { Red, Green }

export class Service_<<k>> extends Base {
  private cache = {};
  constructor(x) {
    super(x);
  }
  async load(id) {
    if (id) {
      return "}";
    }
  }
  handler = () => {
    return 1;
  };
}

export const arrow_<<k>> = (x) => {
  return x;
};
/* class Hidden {
} */
function plain(
  a,
  b,
) {
  return a;
}
"""
_JAVA = """
package com.shop.p<<m>>;

import java.util.List;
import static com.shop.Util.helper;
import com.shop.models.*;

// class Hidden { }
public class Mod<<k>> {
    private int n = 0;

    public Mod<<k>>(int n) {
        this.n = n;
    }

    @Override
    public String toString() {
        return "}" + n;
    }

    static class Inner {
        void work() {
            run();
        }
    }
}

interface Port<<k>> {
    int call(int a);
}

enum Mode { ON, OFF }
"""
_GO = """
package g<<m>>

import (
    "fmt"
    alias "example.com/lib<<k>>"
)

import "strings"

type Store<<k>> struct {
    items map[string]int
}

type Reader interface {
    Read() error
}

type (
    ID int
    Pair struct {
        a int
    }
)

func New<<k>>() *Store<<k>> {
    return nil
}

func (s *Store<<k>>) Get(key string) int {
    if key == "}" {
        return 0
    }
    return s.items[key]
}
"""

_K = "CAST(k AS STRING)"
_M = "CAST(k % 5 AS STRING)"
_CODE_PATH = f"""CASE k % 4
 WHEN 0 THEN 'src/' || slug || '/pkg' || {_M} || CASE WHEN k % 28 = 0
   THEN '/c' || {_K} || '/__init__.py' ELSE '/mod_' || {_K} || '.py' END
 WHEN 1 THEN 'web/' || slug || '/w' || {_M} || CASE k % 3 WHEN 0 THEN '/c' || {_K} || '/index.ts'
   WHEN 1 THEN '/mod_' || {_K} || '.tsx' ELSE '/mod_' || {_K} || '.ts' END
 WHEN 2 THEN 'java/com/' || slug || '/p' || {_M} || '/Mod' || {_K} || '.java'
 ELSE 'internal/' || slug || '/g' || {_M} || '/mod_' || {_K} || '.go' END"""
_CODE_LANGUAGE = """CASE k % 4 WHEN 0 THEN 'python' WHEN 1 THEN CASE k % 3 WHEN 1 THEN 'tsx'
 ELSE 'typescript' END WHEN 2 THEN 'java' ELSE 'go' END"""
_EXTRA_METHOD = "repeat('    def more(self):' || chr(10) || '        return 2' || chr(10), CAST(k % 3 AS INT))"
_CODE_TEXT = f"""CASE k % 4 WHEN 0 THEN {_template(_PYTHON, k=_K, m=_M, extra=_EXTRA_METHOD)}
 WHEN 1 THEN {_template(_TYPESCRIPT, k=_K, m=_M)} WHEN 2 THEN {_template(_JAVA, k=_K, m=_M)}
 ELSE {_template(_GO, k=_K, m=_M)} END"""

_T = "CAST(t AS STRING)"
_TM = "CAST(t % 5 AS STRING)"
_PY_MOD = f"CASE WHEN t % 28 = 0 THEN 'c' || {_T} ELSE 'mod_' || {_T} END"
_REF_MODULE = f"""CASE o_custkey % 4
 WHEN 0 THEN CASE v WHEN 0 THEN 'src.' || tslug || '.pkg' || {_TM} || '.' || {_PY_MOD}
   WHEN 1 THEN 'pkg' || {_TM} || '.' || {_PY_MOD} WHEN 2 THEN 'pkg' || {_TM} WHEN 3 THEN ''
   WHEN 4 THEN 'pkg' || {_TM} || '.' || {_PY_MOD}
   ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'lib' || CAST(t % 7 AS STRING) || '.sub'
     ELSE 'pkg' || {_TM} || '.' || {_PY_MOD} || '.func' END END
 WHEN 1 THEN CASE v WHEN 0 THEN './mod_' || {_T} WHEN 1 THEN '../w' || {_TM} || '/mod_' || {_T}
   WHEN 2 THEN '../../' || tslug || '/w' || {_TM} || '/c' || {_T}
   WHEN 3 THEN '../../' || tslug || '/w' || {_TM} || '/mod_' || {_T} || '.js'
   WHEN 4 THEN '@scope/pkg' || CAST(t % 9 AS STRING) || '/sub'
   ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'lodash'
     ELSE '../../' || tslug || '/w' || {_TM} || '/mod_' || {_T} END END
 WHEN 2 THEN CASE WHEN v < 3 THEN 'com.' || tslug || '.p' || {_TM} || '.Mod' || {_T}
   WHEN v = 3 THEN 'com.' || tslug || '.p' || {_TM} || '.Mod' || {_T} || '.member'
   WHEN v = 4 THEN 'com.' || tslug || '.p' || {_TM} || '.*' ELSE 'java.util.List' END
 ELSE CASE WHEN v < 4 THEN 'example.com/' || lower(repo_id) || '/internal/' || tslug || '/g' || {_TM}
   WHEN v = 4 THEN 'fmt' ELSE 'example.com/' || lower(repo_id) END END"""


def _refs_frame(t: Tables) -> DataFrame:
    files = CORPORA["code_files"].spark(t)
    src = files.select("k", "repo_id", "path", "language")
    target = files.select(F.col("k").alias("t"), F.col("slug").alias("tslug"))
    orders = t.orders.withColumn(
        "t",
        F.expr(
            "(o_orderkey * 7) % (o_custkey + 1) - ((o_orderkey * 7) % (o_custkey + 1)) % 4"
            " + o_custkey % 4"
        ),
    )
    return orders.join(src, F.col("o_custkey") == F.col("k")).join(target, "t")


_REFS_SQL = """(SELECT *, (o_orderkey * 7) % (o_custkey + 1) - ((o_orderkey * 7) % (o_custkey + 1)) % 4
 + o_custkey % 4 AS t FROM orders) o JOIN code_files ON o_custkey = k
 JOIN (SELECT k AS t, slug AS tslug FROM code_files) f USING (t)"""


_PYPROJECT = """
[project]
name = "x"
dependencies = ["django>=4", "click", "unknown-<<k>>", "uvicorn[standard]"]
[project.optional-dependencies]
dev = ["pytest"]
[project.scripts]
serve<<k>> = "app:main"
[tool.poetry.dependencies]
fastapi = "^1"
"""
_REQUIREMENTS = """
Flask==1
numpy[extra]>=1
# comment
-r other.txt
scikit_learn
"""
_GO_MOD = """
module example.com/r<<k>>

require (
    gorm.io/gorm v1
    github.com/gin-gonic/gin v1
)
"""
_MAKEFILE = """
build:
    go
.PHONY: x
VAR:=1
test-all: build
"""
_PACKAGE_JSON = """
{"name": "p<<k>>", "dependencies": {"react": "^18", "left-pad-<<k>>": "1", "Express": "4"},
 "devDependencies": {"jest": "1", "react": "2"}, "scripts": {"dev": "vite", "test": "jest -n <<k>>"}}
"""
_MANIFEST_NAME = """CASE k % 12 WHEN 0 THEN CASE WHEN k % 24 = 0 THEN 'package.json' ELSE 'web/package.json' END
 WHEN 1 THEN 'pyproject.toml' WHEN 2 THEN 'requirements.txt' WHEN 3 THEN 'lib/setup.py' WHEN 4 THEN 'go.mod'
 WHEN 5 THEN 'jvm/pom.xml' WHEN 6 THEN 'build.gradle' WHEN 7 THEN 'Gemfile' WHEN 8 THEN 'composer.json'
 WHEN 9 THEN 'Dockerfile' WHEN 10 THEN CASE WHEN k % 24 = 10 THEN '.github/workflows/ci.yml'
 ELSE 'compose.yml' END ELSE 'Makefile' END"""
_MANIFEST_TEXT = f"""CASE k % 12 WHEN 0 THEN {_template(_PACKAGE_JSON, k="CAST(k AS STRING)")}
 WHEN 1 THEN {_template(_PYPROJECT, k="CAST(k AS STRING)")} WHEN 2 THEN {_template(_REQUIREMENTS)}
 WHEN 3 THEN 'setup(install_requires=["celery>=5", "pandas ~=1", "torch"])'
 WHEN 4 THEN {_template(_GO_MOD, k="CAST(k AS STRING)")} WHEN 5 THEN '<a>Spring-Boot-starter</a> JUnit'
 WHEN 6 THEN 'implementation lombok quarkus' WHEN 7 THEN 'gem "rails"'
 WHEN 8 THEN CASE WHEN k % 24 = 8 THEN '[laravel/framework]' ELSE '[]' END WHEN 11 THEN {_template(_MAKEFILE)} ELSE 'x' END"""


CORPORA: dict[str, Corpus] = {
    "manifest_files": Corpus(
        "customer",
        lambda t: t.customer,
        [
            {"k": "c_custkey"},
            {
                "k": "k",
                "repo_id": "'repo' || CAST((k - k % 12) AS STRING)",
                "path": _MANIFEST_NAME,
                "text": _MANIFEST_TEXT,
            },
        ],
    ),
    "doc_files": Corpus(
        "documents",
        lambda t: t.documents,
        [
            {
                "doc_id": "doc_id",
                "repo_id": "source",
                "path": "lang || '/doc_' || CAST(doc_id AS STRING) || '.txt'",
                "language": "'text'",
                "text": "text",
            }
        ],
    ),
    "tree_files": Corpus(
        _PLACES_SQL,
        _places,
        [
            {
                "k": "c_custkey",
                "repo_id": "r_name",
                "slug": "lower(replace(n_name, ' ', '_'))",
                "c_name": "c_name",
                "c_mktsegment": "c_mktsegment",
            },
            {"*": "*", "dir": _TREE_DIR, "name": _TREE_NAME, "text": _TREE_TEXT},
            {
                "k": "k",
                "repo_id": "repo_id",
                "path": "CASE WHEN dir = '' THEN '' ELSE dir || '/' END || CASE WHEN k % 40 < 16 "
                "THEN 'u' || CAST(k AS STRING) || '/' ELSE '' END || name",
                "size": "CASE WHEN k % 53 = 0 THEN 0 WHEN k % 59 = 0 THEN 600000 + k "
                "ELSE 100 + (k * 37) % 5000 END",
                "is_symlink": "k % 61 = 0",
                "text": "text",
            },
        ],
    ),
    "code_files": Corpus(
        _PLACES_SQL,
        _places,
        [
            {
                "k": "c_custkey",
                "repo_id": "r_name",
                "slug": "lower(replace(n_name, ' ', '_'))",
            },
            {"*": "*", "path": _CODE_PATH, "language": _CODE_LANGUAGE, "text": _CODE_TEXT},
        ],
    ),
    "claims": Corpus(
        "orders JOIN code_files ON o_custkey = k",
        lambda t: t.orders.join(CORPORA["code_files"].spark(t), F.col("o_custkey") == F.col("k")),
        [
            {
                "claim_id": "o_orderkey",
                "k": "k",
                "repo_id": "repo_id",
                "repo_name": "lower(repo_id) || '/app'",
                "true_path": "path",
                "n": "length(text) - length(replace(text, chr(10), '')) + 1",
                "form": "o_orderkey % 9",
                "raw": """CASE o_orderkey % 9 WHEN 0 THEN path WHEN 1 THEN './' || path WHEN 2 THEN upper(path)
 WHEN 3 THEN regexp_replace(path, '^.*/', '') WHEN 4 THEN path || ':2-4' WHEN 5 THEN '`' || path || '#L5`'
 WHEN 6 THEN regexp_replace(path, '^[^/]*/', '') WHEN 7 THEN 'ghost/x_' || CAST(k AS STRING) || '.zz'
 ELSE lower(repo_id) || '/app/' || path END""",
                "start_line": "CAST(CASE o_orderkey % 5 WHEN 1 THEN 5 WHEN 2 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN 99 END AS INT)",
                "end_line": "CAST(CASE o_orderkey % 5 WHEN 1 THEN 50 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 120 END AS INT)",
                "name": """CASE k % 4 WHEN 0 THEN 'Model_' || CAST(k AS STRING) || '.run()' WHEN 1 THEN 'service_' || CAST(k AS STRING)
 WHEN 2 THEN 'Mod' || CAST(k AS STRING) ELSE 'Unknown' || CAST(k AS STRING) END""",
            }
        ],
        needs=("code_files",),
    ),
    "code_refs": Corpus(
        _REFS_SQL,
        _refs_frame,
        [
            {"*": "*", "v": "o_orderkey % 6"},
            {
                "ref_id": "o_orderkey",
                "repo_id": "repo_id",
                "path": "path",
                "language": "language",
                "line": "o_orderkey % 50 + 1",
                "module": _REF_MODULE,
                "level": "CASE WHEN o_custkey % 4 = 0 AND v = 3 THEN 1 "
                "WHEN o_custkey % 4 = 0 AND v = 4 THEN 2 ELSE 0 END",
                "name": f"CASE WHEN o_custkey % 4 = 0 AND v IN (2, 3) THEN {_PY_MOD} END",
            },
        ],
        needs=("code_files",),
    ),
}


def corpus(tables: Tables, name: str) -> DataFrame:
    return CORPORA[name].spark(tables)


def with_corpora(query: str, *names: str) -> str:
    """``query`` for the checking database with the named corpora in front as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CORPORA[name].needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({CORPORA[n].sql()})" for n in ordered)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
