"""Small source trees for extractors: the test tables hold no code."""

from __future__ import annotations

TEXTS = {
    "src/app/__init__.py": "",
    "src/app/auth.py": "import os\nfrom .session import Session\nfrom .config import settings\n\n\nclass Auth(Session):\n    def __init__(self):\n        self.key = os.getenv('APP_KEY')\n\n    async def login(self):\n        return os.environ['APP_DB']\n",
    "src/app/session.py": "class Session:\n    pass\n",
    "src/app/config.py": "import os\nsettings = os.environ.get('APP_DB')\n",
    "src/app/main.py": "from app.auth import Auth\nimport app.config as c, json\n\n\ndef run():\n    return Auth()\n",
    "src/api/routes.py": "from app import auth\nfrom app.auth import (\n    Auth,  # a class\n)\n",
    "tests/test_auth.py": "from app.auth import Auth\n",
    "web/main.ts": "import { a } from './auth';\nimport x from '@lib/deep/util';\nexport * from \"../web/pages\";\nimport React from 'react';\nconst k = process.env.APP_KEY, j = process.env['APP_DB'];\n",
    "web/auth.ts": "const s = require('./missing');\n",
    "web/pages/index.tsx": "import './style.css';\n",
    "lib/deep/util.js": "export const x = 1;\n",
    "crate/Cargo.toml": "[package]\n",
    "crate/src/main.rs": "mod auth;\nuse crate::auth::{login, logout};\nuse std::io;\nuse super::none;\n",
    "crate/src/auth.rs": "use self::token::Token;\n",
    "crate/src/token/mod.rs": "pub struct Token;\n",
    "go.mod": "module example.com/proj\n",
    "cmd/main.go": "package main\nimport \"fmt\"\nimport (\n  // \"example.com/proj/old\"\n  db \"example.com/proj/pkg/db\"\n)\n",
    "pkg/db/db.go": "package db\n",
    "pkg/db/more.go": "package db\n",
    "native/main.cpp": "#include \"auth.h\"\n#include <vector>\n#include <utils/helper.hpp>\n",
    "native/auth.h": "",
    "native/deep/utils/helper.hpp": "",
    "java/A.java": "import com.example.B;\nimport static com.example.util.C;\nimport com.example.all.*;\n",
    "src/main/java/com/example/B.java": "",
    "other/C.java": "",
    "Dockerfile": "COPY src/app/main.py .\nRUN python routes.py\n",
    "README.md": "See auth.py and xsession.py, src/app/config.py.\n",
    "config/app.yaml": "entry: main.py\npath: ./web/main.ts\n",
    "pyproject.toml": "[project]\n",
}


def values(limit_to: str = "") -> str:
    """The texts as an SQL VALUES list; line ends stand as the sign ¶."""
    q = lambda s: "'" + s.replace("'", "''").replace("\n", "¶") + "'"
    return ", ".join(f"({q(p)}, {q(t)})" for p, t in TEXTS.items() if p.endswith(tuple(limit_to.split())) or not limit_to)
