"""The bundled line rules, one entry per rule.

(rule id, language, severity, line pattern, message).  Patterns are Java regular
expressions applied to one code line; rules in TWO_LINE see the next line too.
"""

from __future__ import annotations

_SECRET = r"(?:password|passwd|secret|api_key|apikey|token|auth_key|private_key)\w*"
_JAVA_SECRET = r"(?:password|passwd|secret|apikey|api_key|token|authkey|privatekey)\w*"

RULES = [
    ("python-eval-use", "python", "ERROR", r"(?<![\w.])eval\(",
     "Use of `eval()` is dangerous. It executes arbitrary Python code and is a common vector for "
     "code-injection attacks. Replace with a safe alternative such as `ast.literal_eval()` for data parsing."),
    ("python-exec-use", "python", "ERROR", r"(?<![\w.])exec\(",
     "Use of `exec()` allows arbitrary code execution. Avoid it in production code; prefer "
     "well-defined control flows or restricted DSLs."),
    ("python-subprocess-shell-true", "python", "ERROR",
     r"\bsubprocess\.\w+\(.*\bshell\s*=\s*True\b",
     "subprocess called with shell=True enables shell injection. Pass a list of arguments instead "
     "and set shell=False (the default)."),
    ("python-os-system", "python", "ERROR", r"\bos\.system\(",
     "`os.system()` passes the command string to the shell, enabling injection. Use "
     "`subprocess.run()` with a list of arguments instead."),
    ("python-pickle-loads", "python", "ERROR", r"\bpickle\.loads?\(",
     "`pickle.loads()` / `pickle.load()` deserialises arbitrary Python objects and can execute "
     "malicious code embedded in the payload. Use a safe serialisation format such as JSON."),
    ("python-hardcoded-password-assignment", "python", "WARNING",
     rf"(?i)^\s*{_SECRET}\s*=\s*[\"']",
     "A variable named like a credential is assigned a hard-coded string literal. Store secrets in "
     "environment variables or a secrets manager."),
    ("python-assert-used", "python", "WARNING", r"^\s*assert\b",
     "`assert` statements are stripped by the Python optimiser when run with -O. Do not rely on "
     "assertions for security or input-validation checks; use explicit `if/raise` guards instead."),
    ("python-print-statement", "python", "INFO", r"(?<![\w.])print\(",
     "`print()` found in production code. Replace with structured logging (`logging.info()` / "
     "`logging.debug()` etc.) so output can be controlled at runtime."),
    ("python-bare-except", "python", "WARNING", r"^\s*except\s*:",
     "A bare `except:` clause catches every exception including `SystemExit` and "
     "`KeyboardInterrupt`. Catch specific exception types or use `except Exception` at minimum."),
    ("python-mutable-default-argument", "python", "WARNING",
     r"^\s*(?:async\s+)?def\s+\w+\(.*=\s*(?:\[\]|\{\}|set\(\))",
     "Using a mutable object (list, dict, set) as a default argument value is a common Python "
     "gotcha. The same object is shared across all calls. Use `None` as the default and initialise "
     "inside the function body."),
    ("js-eval-use", "javascript", "ERROR", r"(?<![\w.$])eval\(",
     "`eval()` executes arbitrary JavaScript and is a severe XSS/code-injection risk. Replace with "
     "safer alternatives such as `JSON.parse()` for data or a proper template engine for HTML generation."),
    ("js-innerhtml-assignment", "javascript", "ERROR", r"\.innerHTML\s*=(?!=)",
     "Assigning directly to `innerHTML` can introduce Cross-Site Scripting (XSS) vulnerabilities if "
     "the value contains user-controlled content. Use `textContent` for plain text or a sanitisation "
     "library for HTML."),
    ("js-document-write", "javascript", "WARNING", r"\bdocument\.write\(",
     "`document.write()` can open the document and cause XSS if called with untrusted input. Prefer "
     "DOM manipulation methods such as `document.createElement` and `appendChild`."),
    ("js-no-console-log", "javascript", "INFO", r"\bconsole\.log\(",
     "`console.log()` found. Remove debug logging from production code or replace it with a "
     "structured logging library."),
    ("js-prototype-pollution", "javascript", "ERROR", r"\bObject\.prototype\.\w+\s*=(?!=)",
     "Setting properties on `Object.prototype` can pollute every object in the runtime, leading to "
     "unexpected behaviour and security vulnerabilities."),
    ("js-hardcoded-secret", "javascript", "WARNING", rf"(?i)\bconst\s+{_SECRET}\s*=\s*[\"']",
     "A variable named like a credential is assigned a hard-coded string. Store secrets in "
     "environment variables or a dedicated secrets manager."),
    ("ts-eval-use", "typescript", "ERROR", r"(?<![\w.$])eval\(",
     "`eval()` executes arbitrary code at runtime. It bypasses TypeScript's type safety and is a "
     "common XSS/injection vector. Avoid it entirely."),
    ("ts-innerhtml-assignment", "typescript", "ERROR", r"\.innerHTML\s*=(?!=)",
     "Assigning to `innerHTML` with unvalidated data causes XSS. Use `textContent` for plain text or "
     "a sanitisation utility for trusted HTML."),
    ("ts-no-explicit-any", "typescript", "INFO", r":\s*any\b",
     "Using the `any` type defeats TypeScript's static type checking. Prefer a specific type, "
     "`unknown`, or a well-typed generic instead."),
    ("ts-no-console-log", "typescript", "INFO", r"\bconsole\.log\(",
     "`console.log()` found. Remove debug output from production code or replace with a structured "
     "logging library."),
    ("ts-hardcoded-secret", "typescript", "WARNING", rf"(?i)\bconst\s+{_SECRET}\s*=\s*[\"']",
     "A variable named like a credential is assigned a hard-coded string. Store secrets in "
     "environment variables or a secrets manager."),
    ("java-runtime-exec", "java", "ERROR", r"\bRuntime\.getRuntime\(\)\.exec\(",
     "`Runtime.getRuntime().exec()` or `ProcessBuilder` invoked with a string that may include "
     "user-supplied input enables OS command injection. Validate and whitelist all input before "
     "passing it to a process."),
    ("java-sql-string-concat", "java", "ERROR",
     r"(?i)\"\s*(?:select|insert|update|delete|from|where)\b[^\"]*\"\s*\+",
     "Building a SQL query by string concatenation with user input opens the door to SQL injection. "
     "Use PreparedStatement with parameterised queries."),
    ("java-system-exit", "java", "WARNING", r"\bSystem\.exit\(",
     "Calling `System.exit()` inside application logic terminates the whole JVM, bypassing finally "
     "blocks and shutdown hooks. Throw an exception or return an error code instead."),
    ("java-printStackTrace", "java", "INFO", r"\.printStackTrace\(\)",
     "`e.printStackTrace()` sends the stack trace to stderr, which may expose internal details in "
     "production logs. Use a proper logging framework (SLF4J, Log4j2, etc.) and log at the "
     "appropriate level."),
    ("java-hardcoded-password", "java", "WARNING", rf"(?i)\bString\s+{_JAVA_SECRET}\s*=\s*\"",
     "A variable whose name suggests it is a credential is assigned a hard-coded string. Store "
     "secrets in environment variables, configuration files, or a secrets manager."),
    ("cpp-gets-usage", "cpp", "ERROR", r"(?<![\w.>])gets\(",
     "`gets()` is unsafe and has been removed from C11 and C++14. It cannot prevent buffer overflows "
     "because it does not limit the number of characters read. Use `fgets()` or `std::getline()` instead."),
    ("cpp-strcpy-usage", "cpp", "ERROR", r"(?<![\w.>])strcpy\(",
     "`strcpy()` does not check destination buffer size and can cause buffer overflows. Use "
     "`strncpy()`, `strlcpy()`, or `std::string` instead."),
    ("cpp-strcat-usage", "cpp", "ERROR", r"(?<![\w.>])strcat\(",
     "`strcat()` does not check destination buffer size and can cause buffer overflows. Use "
     "`strncat()`, `strlcat()`, or `std::string::append()` instead."),
    ("cpp-sprintf-usage", "cpp", "WARNING", r"(?<![\w.>])sprintf\(",
     "`sprintf()` does not perform bounds checking on the output buffer. Use `snprintf()` with an "
     "explicit buffer size or `std::ostringstream` instead."),
    ("cpp-printf-user-input", "cpp", "WARNING", r"(?<![\w.>])printf\(\s*[A-Za-z_]\w*\s*[,)]",
     "Passing a potentially attacker-controlled format string directly to `printf()` enables "
     "format-string exploits. Always use a literal format string: `printf(\"%s\", user_input)`."),
    ("cpp-system-call", "cpp", "ERROR", r"(?<![\w.>])system\(",
     "`system()` passes the command to the shell, enabling command injection. Use `execv()` family "
     "functions with validated arguments instead."),
    ("cpp-malloc-no-check", "cpp", "WARNING",
     r"(\w+)\s*=\s*(?:\([^)]*\)\s*)?malloc\([^;]*\);\s*\*\1\s*;",
     "The return value of `malloc()` is not checked for NULL. A NULL return means allocation failed; "
     "dereferencing it causes undefined behaviour. Always check the return value before use."),
]

# rules that need the next line, with the pattern of a line they may start on
TWO_LINE = {"cpp-malloc-no-check": r"\bmalloc\("}
