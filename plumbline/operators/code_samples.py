"""Small source texts of our own, one a shape that the code operators tell apart."""

SAMPLES = [
    ("src/plain.py", "python", "def add(a, b):\n    total = a + b\n    return total\n"),
    ("src/nested.py", "python", "def scan(rows):\n    found = []\n    for row in rows:\n        if row and row[0] > 3:\n            found.append(row)\n        elif not row:\n            continue\n    return found\n\n\nclass Box:\n    def __init__(self, n):\n        self.n = n\n"),
    ("src/with_tests.py", "python", "import math\n\n\ndef area(r):\n    return math.pi * r * r\n\n\ndef test_area():\n    assert area(0) == 0\n\n\nclass TestArea:\n    def test_one(self):\n        assert area(1) > 3\n"),
    ("src/types.py", "python", "from dataclasses import dataclass\nfrom enum import Enum\n\n\n@dataclass\nclass Point:\n    x: int\n    y: int\n\n\nclass Color(Enum):\n    RED = 1\n    BLUE = 2\n"),
    ("src/table.py", "python", "ROWS = [\n    {'a': 1, 'b': 2},\n    {'a': 3, 'b': 4},\n    {'a': 5, 'b': 6},\n]\n"),
    ("pkg/__init__.py", "python", "from .a import one\nfrom .b import two\n\n__all__ = [\n    \"one\",\n    \"two\",\n]\n"),
    ("src/broken.py", "python", "def broken(:\n    return 1 +\n"),
    ("src/empty.py", "python", ""),
    ("src/blank.py", "python", "  \n\n"),
    ("src/tiny.py", "python", "x = 1\n"),
    ("src/plain.js", "javascript", "function add(a, b) {\n  const total = a + b;\n  if (total > 3 && a) {\n    return total;\n  }\n  return 0;\n}\n"),
    ("src/table.js", "javascript", "export const rows = [\n  { a: 1 },\n  { a: 2 },\n];\n"),
    ("src/shape.ts", "typescript", "export interface Shape {\n  name: string;\n  area: number;\n}\n\nexport enum Kind {\n  A,\n  B,\n}\n"),
    ("src/main.go", "go", "package main\n\ntype Point struct {\n\tX int\n\tY int\n}\n\nfunc (p Point) Sum() int {\n\treturn p.X + p.Y\n}\n\nfunc Add(a int, b int) int {\n\tc := a + b\n\tif c > 3 {\n\t\treturn c\n\t}\n\treturn 0\n}\n"),
    ("src/lib.rs", "rust", "pub fn add(a: i32, b: i32) -> i32 {\n    if a > b {\n        return a;\n    }\n    a + b\n}\n\n#[cfg(test)]\nmod tests {\n    use super::*;\n\n    #[test]\n    fn works() {\n        assert_eq!(add(1, 2), 3);\n    }\n}\n"),
    ("src/Adder.java", "java", "class Adder {\n  int add(int a, int b) {\n    if (a > b) {\n      return a;\n    }\n    return a + b;\n  }\n}\n"),
    ("src/add.xyz", "fortran", "program add\nend program\n"),
]
