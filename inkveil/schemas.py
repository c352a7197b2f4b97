"""Schemas of the stored tables and the domains of their enumerated columns."""

from inkveil import constants as c

TASKS = (
    "id string, filename string, file_size bigint, file_type string, upload_time timestamp, status string, "
    "content string, file_metadata map<string,string>, created_at timestamp, updated_at timestamp"
)
ITEMS = (
    "id string, task_id string, type string, value string, start_pos int, end_pos int, confidence double, "
    "created_at timestamp"
)
RULES = (
    "id string, name string, data_type string, strategy string, is_system boolean, enabled boolean, "
    "created_at timestamp, updated_at timestamp"
)
LOGS = "id string, task_id string, operation_type string, user_id string, details string, created_at timestamp"

#: Column -> allowed values.
DOMAINS = {
    "file_type": c.FILE_TYPES,
    "status": c.TASK_STATUSES,
    "type": c.DATA_TYPES,
    "data_type": c.DATA_TYPES,
    "strategy": c.STRATEGIES,
    "operation_type": c.OPERATIONS,
}
