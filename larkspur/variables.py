"""System variables, and the fixed rows that SHOW commands return."""

from __future__ import annotations

import logging

log = logging.getLogger(__name__)

# Name, default, scope (b both, g global only), whether read-only.
_VARIABLES = """
character_set_client|utf8mb4|b|
character_set_connection|utf8mb4|b|
character_set_database|utf8mb4|b|
character_set_results|utf8mb4|b|
character_set_server|utf8mb4|b|
character_set_system|utf8|g|r
collation_connection|utf8mb4_general_ci|b|
collation_database|utf8mb4_general_ci|b|
collation_server|utf8mb4_general_ci|b|
auto_increment_increment|1|b|
auto_increment_offset|1|b|
connect_timeout|10|g|
interactive_timeout|28800|b|
net_read_timeout|30|b|
net_write_timeout|60|b|
wait_timeout|28800|b|
max_allowed_packet|67108864|b|
net_buffer_length|16384|b|
sql_mode|STRICT_TRANS_TABLES,NO_ZERO_DATE,NO_ZERO_IN_DATE,ERROR_FOR_DIVISION_BY_ZERO|b|
init_connect||g|
tx_isolation|REPEATABLE-READ|b|
transaction_isolation|REPEATABLE-READ|b|
tx_read_only|0|b|
transaction_read_only|0|b|
autocommit|ON|b|
time_zone|SYSTEM|b|
system_time_zone|CST|g|r
query_cache_type|OFF|b|
query_cache_size|0|g|
version|8.0.32|g|r
version_comment|larkspur|g|r
version_compile_machine|x86_64|g|r
version_compile_os|Linux|g|r
license|GPL|g|r
lower_case_table_names|0|g|r
performance_schema|ON|g|r
innodb_version|8.0.32|g|r
innodb_buffer_pool_size|134217728|g|r
innodb_page_size|16384|g|r
innodb_log_file_size|50331648|g|r
innodb_file_per_table|ON|g|
innodb_flush_log_at_trx_commit|1|g|
hostname|localhost|g|r
port|3309|g|r
socket|/tmp/mysql.sock|g|r
datadir|data/|g|r
basedir|/usr/local/mysql/|g|r
thread_stack|1048576|g|r
thread_cache_size|8|g|
max_connections|151|g|
read_only|OFF|g|
log_bin|OFF|g|r
server_id|1|g|
log_error|/var/log/mysql/error.log|g|
general_log|OFF|g|
slow_query_log|OFF|g|
"""
STATUS = {"Threads_connected": "5", "Threads_running": "2"}
STATUS_SESSION = {"Com_select": "10", "Com_insert": "2"}
STATUS_GLOBAL = {"Uptime": "86400", "Questions": "50000"}
ENGINES = [
    ("InnoDB", "DEFAULT", "Supports transactions, row-level locking, and foreign keys", "YES", "YES", "YES"),
    ("MyISAM", "NO", "MyISAM storage engine", "NO", "NO", "NO"),
    ("MEMORY", "NO", "Hash based, stored in memory, useful for temporary tables", "NO", "NO", "NO"),
    ("CSV", "NO", "CSV storage engine", "NO", "NO", "NO"),
    ("ARCHIVE", "NO", "Archive storage engine", "NO", "NO", "NO"),
    ("PERFORMANCE_SCHEMA", "NO", "Performance Schema", "NO", "NO", "NO"),
    ("FEDERATED", "NO", "Federated MySQL storage engine", "NULL", "NULL", "NULL"),
]
CHARSETS = [
    ("utf8", "UTF-8 Unicode", "utf8_general_ci", 3),
    ("utf8mb4", "UTF-8 Unicode", "utf8mb4_0900_ai_ci", 4),
    ("latin1", "cp1252 West European", "latin1_swedish_ci", 1),
    ("ascii", "US ASCII", "ascii_general_ci", 1),
    ("binary", "Binary pseudo charset", "binary", 1),
]
COLLATIONS = [
    ("utf8mb4_0900_ai_ci", "utf8mb4", 255, "Yes", "Yes", 0, "NO PAD"),
    ("utf8mb4_general_ci", "utf8mb4", 45, "", "Yes", 1, "PAD SPACE"),
    ("utf8_general_ci", "utf8", 33, "Yes", "Yes", 1, "PAD SPACE"),
    ("latin1_swedish_ci", "latin1", 8, "Yes", "Yes", 1, "PAD SPACE"),
    ("ascii_general_ci", "ascii", 11, "Yes", "Yes", 1, "PAD SPACE"),
    ("binary", "binary", 63, "Yes", "Yes", 1, "NO PAD"),
]
SYSTEM_DATABASES = ["information_schema", "mysql", "performance_schema", "sys"]


class Variables:
    """Global values, shared, and a session's own."""

    rows = [tuple(x.split("|")) for x in _VARIABLES.strip().split("\n")]
    defaults = {n: v for n, v, _, _ in rows}
    session_scope = {n for n, _, s, _ in rows if s == "b"}
    fixed = {n for n, _, _, r in rows if r}

    def __init__(self) -> None:
        self.globals = dict(self.defaults)
        self.own = {n: self.defaults[n] for n in self.session_scope}
        self.user: dict[str, str | None] = {}

    def get(self, name: str, scope: str = "") -> str:
        name = name.lower()
        if name not in self.defaults:
            raise KeyError(name)
        if scope.upper() == "GLOBAL":
            return self.globals[name]
        return self.own.get(name, self.globals[name])

    def set(self, name: str, value: str | None, scope: str = "") -> bool:
        """Whether it was set; unknown and read-only ones are only logged."""
        name = name.lower()
        if name not in self.defaults or name in self.fixed:
            log.warning("variable %s is %s; left as it is", name, "read-only" if name in self.fixed else "unknown")
            return False
        value = self.defaults[name] if value is None or value.upper() == "DEFAULT" else value
        if scope.upper() == "GLOBAL" or name not in self.session_scope:
            self.globals[name] = value
        if scope.upper() != "GLOBAL" and name in self.session_scope:
            self.own[name] = value
        return True

    def all(self, scope: str = "") -> dict[str, str]:
        return {n: self.get(n, scope) for n in sorted(self.defaults)}
