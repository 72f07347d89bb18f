"""Fixed values of the data model.

Column names, types, allowed values, defaults, keys and references are part of the data contract:
they have to be exactly these for results to be right, so they are stated plainly and together.
"""

# ---------------------------------------------------------------------------------------------
# Tables: columns, types and declared NOT NULL. JSON documents and times of day are kept as text at
# rest, which every source and sink takes.
# ---------------------------------------------------------------------------------------------
TABLES = {
    "users": """
        id BIGINT NOT NULL, uuid STRING NOT NULL, username STRING NOT NULL, email STRING NOT NULL,
        password_hash STRING NOT NULL, full_name STRING NOT NULL, phone STRING, role STRING,
        status STRING, avatar_url STRING, last_login TIMESTAMP_NTZ, login_attempts INT,
        locked_until TIMESTAMP_NTZ, email_verified BOOLEAN, phone_verified BOOLEAN,
        two_factor_enabled BOOLEAN, two_factor_secret STRING, preferences STRING,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "hubs": """
        id BIGINT NOT NULL, uuid STRING NOT NULL, name STRING NOT NULL, code STRING NOT NULL,
        address STRING NOT NULL, city STRING NOT NULL, state STRING NOT NULL,
        country STRING NOT NULL, postal_code STRING NOT NULL, latitude DECIMAL(10,8),
        longitude DECIMAL(11,8), capacity INT, current_load INT,
        utilization_percentage DECIMAL(5,2), status STRING, hub_type STRING,
        contact_person STRING, contact_phone STRING, contact_email STRING,
        operating_hours STRING, facilities STRING, manager_id BIGINT,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "routes": """
        id BIGINT NOT NULL, uuid STRING NOT NULL, name STRING NOT NULL, code STRING NOT NULL,
        origin_hub_id BIGINT NOT NULL, destination_hub_id BIGINT NOT NULL,
        distance_km DECIMAL(10,2), estimated_duration_minutes INT, cost_per_kg DECIMAL(10,2),
        base_cost DECIMAL(10,2), route_type STRING, status STRING, priority INT,
        max_weight_kg DECIMAL(10,2), max_volume_m3 DECIMAL(10,2), schedule STRING, notes STRING,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "shipments": """
        id BIGINT NOT NULL, uuid STRING NOT NULL, tracking_number STRING NOT NULL,
        reference_number STRING, sender_name STRING NOT NULL, sender_email STRING,
        sender_phone STRING, sender_address STRING NOT NULL, sender_city STRING NOT NULL,
        sender_state STRING NOT NULL, sender_country STRING NOT NULL,
        sender_postal_code STRING NOT NULL, receiver_name STRING NOT NULL, receiver_email STRING,
        receiver_phone STRING, receiver_address STRING NOT NULL, receiver_city STRING NOT NULL,
        receiver_state STRING NOT NULL, receiver_country STRING NOT NULL,
        receiver_postal_code STRING NOT NULL, origin_hub_id BIGINT, destination_hub_id BIGINT,
        current_hub_id BIGINT, package_count INT, total_weight_kg DECIMAL(10,2) NOT NULL,
        dimensions_length_cm DECIMAL(8,2), dimensions_width_cm DECIMAL(8,2),
        dimensions_height_cm DECIMAL(8,2), volume_m3 DECIMAL(10,4),
        content_description STRING NOT NULL, content_value DECIMAL(12,2),
        content_category STRING, service_type STRING, delivery_instructions STRING,
        special_handling STRING, declared_value DECIMAL(12,2), insurance_value DECIMAL(12,2),
        base_cost DECIMAL(10,2) NOT NULL, fuel_surcharge DECIMAL(10,2),
        insurance_cost DECIMAL(10,2), additional_fees DECIMAL(10,2), total_cost DECIMAL(10,2),
        currency STRING, status STRING, priority STRING, pickup_date DATE,
        pickup_time_start STRING, pickup_time_end STRING, estimated_delivery_date DATE,
        estimated_delivery_time STRING, actual_pickup_datetime TIMESTAMP_NTZ,
        actual_delivery_datetime TIMESTAMP_NTZ, assigned_route_id BIGINT,
        assigned_driver_id BIGINT, assigned_vehicle STRING, created_by_id BIGINT NOT NULL,
        updated_by_id BIGINT, notes STRING, tags STRING, metadata STRING,
        created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "shipment_events": """
        id BIGINT NOT NULL, shipment_id BIGINT NOT NULL, event_type STRING NOT NULL,
        status STRING NOT NULL, location STRING, hub_id BIGINT, description STRING NOT NULL,
        notes STRING, user_id BIGINT, event_datetime TIMESTAMP_NTZ, metadata STRING,
        created_at TIMESTAMP_NTZ""",
    "daily_analytics": """
        id BIGINT NOT NULL, date DATE NOT NULL, hub_id BIGINT, total_shipments BIGINT,
        completed_shipments BIGINT, pending_shipments BIGINT, failed_shipments BIGINT,
        total_revenue DECIMAL(12,2), total_costs DECIMAL(12,2), net_profit DECIMAL(12,2),
        average_delivery_time_hours DECIMAL(8,2), on_time_delivery_rate DECIMAL(5,2),
        total_weight_processed_kg DECIMAL(12,2), total_packages_processed BIGINT,
        hub_utilization_rate DECIMAL(5,2), route_efficiency_score DECIMAL(5,2),
        customer_satisfaction_score DECIMAL(3,1), created_at TIMESTAMP_NTZ,
        updated_at TIMESTAMP_NTZ""",
    "performance_metrics": """
        id BIGINT NOT NULL, metric_name STRING NOT NULL, metric_value DECIMAL(15,4) NOT NULL,
        metric_unit STRING, category STRING NOT NULL, subcategory STRING, hub_id BIGINT,
        user_id BIGINT, recorded_at TIMESTAMP_NTZ, metadata STRING""",
    "process_definitions": """
        id BIGINT NOT NULL, name STRING NOT NULL, version STRING NOT NULL, description STRING,
        process_type STRING NOT NULL, definition_data STRING NOT NULL, is_active BOOLEAN,
        created_by_id BIGINT NOT NULL, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "process_instances": """
        id BIGINT NOT NULL, process_definition_id BIGINT NOT NULL, instance_name STRING,
        status STRING, started_by_id BIGINT NOT NULL, related_shipment_id BIGINT,
        context_data STRING, started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ,
        error_message STRING""",
    "process_activities": """
        id BIGINT NOT NULL, process_instance_id BIGINT NOT NULL, activity_name STRING NOT NULL,
        activity_type STRING NOT NULL, status STRING, assigned_to_id BIGINT,
        started_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, duration_seconds INT,
        input_data STRING, output_data STRING, error_message STRING""",
    "system_settings": """
        id BIGINT NOT NULL, setting_key STRING NOT NULL, setting_value STRING NOT NULL,
        setting_type STRING, category STRING NOT NULL, description STRING, is_editable BOOLEAN,
        is_sensitive BOOLEAN, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
    "user_sessions": """
        id BIGINT NOT NULL, session_token STRING NOT NULL, user_id BIGINT NOT NULL,
        ip_address STRING, user_agent STRING, expires_at TIMESTAMP_NTZ NOT NULL,
        is_active BOOLEAN, created_at TIMESTAMP_NTZ""",
    "notifications": """
        id BIGINT NOT NULL, user_id BIGINT NOT NULL, title STRING NOT NULL,
        message STRING NOT NULL, type STRING, category STRING, is_read BOOLEAN,
        related_entity_type STRING, related_entity_id BIGINT, action_url STRING,
        expires_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ""",
    # The flat shipment document with its nested parts.
    "shipment_documents": """
        id STRING NOT NULL, tracking_number STRING NOT NULL, sender_name STRING NOT NULL,
        sender_phone STRING, sender_address STRING NOT NULL, receiver_name STRING NOT NULL,
        receiver_phone STRING, receiver_address STRING NOT NULL, package_details STRING NOT NULL,
        weight DECIMAL(10,2) NOT NULL,
        dimensions STRUCT<length: DOUBLE, width: DOUBLE, height: DOUBLE> NOT NULL,
        service_type STRING NOT NULL, status STRING NOT NULL, pickup_date TIMESTAMP_NTZ,
        estimated_delivery TIMESTAMP_NTZ, actual_delivery TIMESTAMP_NTZ, route STRING,
        hub_id STRING,
        events ARRAY<STRUCT<id: STRING, timestamp: TIMESTAMP_NTZ, status: STRING,
                            location: STRING, description: STRING>>,
        cost DECIMAL(10,2) NOT NULL, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ""",
}

# ---------------------------------------------------------------------------------------------
# Vocabularies
# ---------------------------------------------------------------------------------------------
ACTIVE_STATUSES = [
    "created", "accepted", "collected", "in_transit", "at_hub", "out_for_delivery",
]
FAILED_STATUSES = ["failed_delivery", "returned", "cancelled", "lost", "damaged"]
SHIPMENT_STATUSES = [
    "created", "accepted", "collected", "in_transit", "at_hub", "out_for_delivery", "delivered",
    "failed_delivery", "returned", "cancelled", "lost", "damaged",
]
DOCUMENT_STATUSES = [
    "pending", "picked_up", "in_transit", "out_for_delivery", "delivered", "failed",
]
DOCUMENT_SERVICES = ["standard", "express", "overnight"]
PAYLOAD_HUB_STATUSES = ["active", "inactive", "maintenance"]

# Columns whose value must be in a list (NULL passes).
ALLOWED = {
    ("users", "role"): ["admin", "manager", "operator", "viewer"],
    ("users", "status"): ["active", "inactive", "suspended"],
    ("hubs", "status"): ["active", "inactive", "maintenance", "closed"],
    ("hubs", "hub_type"): ["distribution", "sorting", "pickup", "delivery", "storage"],
    ("routes", "route_type"): ["ground", "air", "sea", "rail"],
    ("routes", "status"): ["active", "inactive", "suspended", "maintenance"],
    ("shipments", "service_type"): ["standard", "express", "overnight", "economy"],
    ("shipments", "status"): SHIPMENT_STATUSES,
    ("shipments", "priority"): ["low", "normal", "high", "urgent"],
    ("shipment_events", "event_type"): [
        "created", "accepted", "collected", "departed_hub", "arrived_hub", "in_transit",
        "out_for_delivery", "delivered", "failed_delivery", "returned", "cancelled", "damaged",
        "lost", "exception",
    ],
    ("process_instances", "status"): ["running", "completed", "failed", "suspended"],
    ("process_activities", "status"): ["pending", "active", "completed", "failed", "skipped"],
    ("system_settings", "setting_type"): ["string", "number", "boolean", "json"],
    ("notifications", "type"): ["info", "success", "warning", "error"],
    ("shipment_documents", "service_type"): DOCUMENT_SERVICES,
    ("shipment_documents", "status"): DOCUMENT_STATUSES,
}

# Columns with a numeric condition (NULL passes).
NUMERIC_CHECKS = {
    ("hubs", "capacity"): "capacity > 0",
    ("hubs", "current_load"): "current_load >= 0",
    ("routes", "distance_km"): "distance_km > 0",
    ("routes", "estimated_duration_minutes"): "estimated_duration_minutes > 0",
    ("routes", "priority"): "priority between 1 and 10",
    ("routes", "no_self_route"): "origin_hub_id <> destination_hub_id",
    ("shipments", "package_count"): "package_count > 0",
    ("shipments", "total_weight_kg"): "total_weight_kg > 0",
}

# ---------------------------------------------------------------------------------------------
# Keys and references
# ---------------------------------------------------------------------------------------------
UNIQUE_KEYS = {
    "users": [["id"], ["uuid"], ["username"], ["email"]],
    "hubs": [["id"], ["uuid"], ["name"], ["code"]],
    "routes": [["id"], ["uuid"], ["code"]],
    "shipments": [["id"], ["uuid"], ["tracking_number"]],
    "shipment_events": [["id"]],
    "daily_analytics": [["id"], ["date", "hub_id"]],
    "performance_metrics": [["id"]],
    "process_definitions": [["id"], ["name", "version"]],
    "process_instances": [["id"]],
    "process_activities": [["id"]],
    "system_settings": [["id"], ["setting_key"]],
    "user_sessions": [["id"], ["session_token"]],
    "notifications": [["id"]],
    "shipment_documents": [["id"], ["tracking_number"]],
}

# (child table, column, parent table, does deleting the parent delete the child)
FOREIGN_KEYS = [
    ("hubs", "manager_id", "users", False),
    ("routes", "origin_hub_id", "hubs", True),
    ("routes", "destination_hub_id", "hubs", True),
    ("shipments", "origin_hub_id", "hubs", False),
    ("shipments", "destination_hub_id", "hubs", False),
    ("shipments", "current_hub_id", "hubs", False),
    ("shipments", "assigned_route_id", "routes", False),
    ("shipments", "assigned_driver_id", "users", False),
    ("shipments", "created_by_id", "users", False),
    ("shipments", "updated_by_id", "users", False),
    ("shipment_events", "shipment_id", "shipments", True),
    ("shipment_events", "hub_id", "hubs", False),
    ("shipment_events", "user_id", "users", False),
    ("daily_analytics", "hub_id", "hubs", False),
    ("performance_metrics", "hub_id", "hubs", False),
    ("performance_metrics", "user_id", "users", False),
    ("process_definitions", "created_by_id", "users", False),
    ("process_instances", "process_definition_id", "process_definitions", False),
    ("process_instances", "started_by_id", "users", False),
    ("process_instances", "related_shipment_id", "shipments", False),
    ("process_activities", "process_instance_id", "process_instances", True),
    ("process_activities", "assigned_to_id", "users", False),
    ("user_sessions", "user_id", "users", True),
    ("notifications", "user_id", "users", True),
]

# ---------------------------------------------------------------------------------------------
# Defaults, as SQL expressions; AS_OF stands for the load time, NEW_UUID for a fresh identifier.
# ---------------------------------------------------------------------------------------------
AS_OF = "as_of"
NEW_UUID = "new_uuid"
DEFAULTS = {
    "users": {
        "uuid": NEW_UUID, "role": "'operator'", "status": "'active'", "login_attempts": "0",
        "email_verified": "false", "phone_verified": "false", "two_factor_enabled": "false",
        "preferences": "'{}'", "created_at": AS_OF, "updated_at": AS_OF,
    },
    "hubs": {
        "uuid": NEW_UUID, "capacity": "1000", "current_load": "0", "status": "'active'",
        "hub_type": "'distribution'",
        "operating_hours": """'{"monday": "09:00-17:00", "tuesday": "09:00-17:00", "wednesday": "09:00-17:00", "thursday": "09:00-17:00", "friday": "09:00-17:00", "saturday": "09:00-13:00", "sunday": "closed"}'""",
        "facilities": "'[]'", "created_at": AS_OF, "updated_at": AS_OF,
    },
    "routes": {
        "uuid": NEW_UUID, "cost_per_kg": "0.00", "base_cost": "0.00", "route_type": "'ground'",
        "status": "'active'", "priority": "1", "max_weight_kg": "1000.00",
        "max_volume_m3": "50.00", "schedule": "'{}'", "created_at": AS_OF, "updated_at": AS_OF,
    },
    "shipments": {
        "uuid": NEW_UUID, "package_count": "1", "content_category": "'general'",
        "service_type": "'standard'", "special_handling": "'[]'", "base_cost": "0.00",
        "fuel_surcharge": "0.00", "insurance_cost": "0.00", "additional_fees": "0.00",
        "currency": "'USD'", "status": "'created'", "priority": "'normal'", "tags": "'[]'",
        "metadata": "'{}'", "created_at": AS_OF, "updated_at": AS_OF,
    },
    "shipment_events": {"event_datetime": AS_OF, "metadata": "'{}'", "created_at": AS_OF},
    "daily_analytics": {
        "total_shipments": "0", "completed_shipments": "0", "pending_shipments": "0",
        "failed_shipments": "0", "total_revenue": "0.00", "total_costs": "0.00",
        "total_weight_processed_kg": "0.00", "total_packages_processed": "0",
        "created_at": AS_OF, "updated_at": AS_OF,
    },
    "performance_metrics": {"recorded_at": AS_OF, "metadata": "'{}'"},
    "process_definitions": {"is_active": "true", "created_at": AS_OF, "updated_at": AS_OF},
    "process_instances": {"status": "'running'", "context_data": "'{}'", "started_at": AS_OF},
    "process_activities": {"status": "'pending'", "input_data": "'{}'", "output_data": "'{}'"},
    "system_settings": {
        "setting_type": "'string'", "is_editable": "true", "is_sensitive": "false",
        "created_at": AS_OF, "updated_at": AS_OF,
    },
    "user_sessions": {"is_active": "true", "created_at": AS_OF},
    "notifications": {
        "type": "'info'", "category": "'general'", "is_read": "false", "created_at": AS_OF,
    },
    "shipment_documents": {
        "service_type": "'standard'", "status": "'pending'", "created_at": AS_OF,
        "updated_at": AS_OF,
    },
}

# ---------------------------------------------------------------------------------------------
# Business constants
# ---------------------------------------------------------------------------------------------
DELIVERY_DAYS = {"standard": 3, "express": 2, "overnight": 1}
SLOW_DELIVERY_DAYS = {"standard": 5, "express": 3, "overnight": 1}
DEFAULT_SERVICE = "standard"

TRACKING_PREFIX = "BC"
TRACKING_COUNTERS = 1000

INITIAL_STATUS = "pending"
INITIAL_LOCATION = "Origin Hub"
INITIAL_DESCRIPTION = "Shipment created and pending pickup"

# Columns added to hubs by the migration, and the retyped key.
HUB_MIGRATION = {
    "code": "STRING", "city": "STRING", "state": "STRING", "pincode": "STRING",
    "phone": "STRING", "manager": "STRING", "updated_at": "TIMESTAMP_NTZ",
}
HUB_RETYPE = {"id": "STRING"}

# Longest accepted text in shipment payloads.
PAYLOAD_LENGTHS = {
    "sender_name": 255, "receiver_name": 255, "sender_phone": 20, "receiver_phone": 20,
    "route": 255, "hub_id": 50,
}
