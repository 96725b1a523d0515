"""Fixed schemas: registries, the batch sheet, the intake form."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: The columns every registry has, and each table's extra columns.
REGISTRY_COLUMNS = ("NAME", "UID", "CREATED_DATE_TIME", "CREATED_BY")
REGISTRY_EXTRAS = {
    "REGISTERED_USERS": (),
    "ACQUISITION_SITES": (),
    "GROUPS": (),
    "SUBJECTS": ("ACQUISITION_SITE", "GROUP"),
    "IMAGE_HASHES": ("SUBJECT", "INSTANCE_NUM"),
    "SURGEONS": ("FIRST_NAME", "LAST_NAME", "MIDDLE_INITIAL"),
}


def registry_schema(*extras: str) -> T.StructType:
    return T.StructType(strings(*REGISTRY_COLUMNS, *extras))


#: The batch sheet's columns and what each requires.
SHEET_COLUMNS = {
    "Filer HawkID": "required",
    "Operation Date": "required",
    "Quality": "optional",
    "Institution Name": "required",
    "Procedure Name": "required",
    "Epic Start Time": "required",
    "Epic End Time": "optional",
    "Side of Patient Body": "optional",
    "OR Room Name/ Location": "optional",
    "Supervising Surgeon HawkID": "optional",
    "Supervising Surgeon Presence": "conditional",
    "Performing Surgeon HawkID": "required",
    "Performing Surgeon # Years Experience": "optional",
    "Performing Surgeon # Prior Cases": "optional",
    "# of Participating Performing Surgeons": "optional",
    "Performer HawkID-Task": "conditional",
    "Unusual Features": "optional",
    "Diagnostic Notes": "optional",
    "Additional Comments": "optional",
    "Skills Assessment Requested": "required",
    "Assessor HawkID": "required",
    "Additional Assessment Details": "conditional",
    "Name/ Type of Storage Device": "optional",
    "Full Path to Data": "required",
    "Was Radiology Contacted": "optional",
    "Radiology Contact Date": "optional",
    "Radiology Contact Time": "optional",
}

_SURGERY = strings(
    "INSTITUTION_NAME", "PROCEDURE_TYPE", "PROCEDURE_NAME", "EPIC_START_TIME", "EPIC_END_TIME", "PATIENT_SIDE",
    "OR_LOCATION", "SUPERVISING_SURGEON_UID", "SUPERVISING_SURGEON_PRESENCE", "PERFORMING_SURGEON_UID",
    "PERFORMER_YEAR_IN_RESIDENCY", "PERFORMER_WAS_ASSISTED", "PERFORMER_NUM_OF_SIMILAR_LOGGED_CASES",
    "PERFORMANCE_ENUMERATED_TASK_PER_PERFORMER", "LIST_UNUSUAL_FEATURES", "DIAGNOSTIC_NOTES", "MISC_PROCEDURE_COMMENTS",
)

INTAKE_FORM = T.StructType(
    strings("FORM_LAST_MODIFIED", "OPERATION_DATE", "SUBJECT_UID", "FILER_HAWKID", "FORM_AVAILABLE_FOR_PERFORMANCE", "SCAN_QUALITY")
    + [
        T.StructField("SURGICAL_PROCEDURE_INFO", T.StructType(_SURGERY)),
        T.StructField("SKILLS_ASSESSMENT_INFO", T.StructType(strings("ASSESSMENT_TITLE", "ASSESSOR_UID", "ASSESSMENT_DETAILS"))),
        T.StructField("STORAGE_DEVICE_INFO", T.StructType(strings("STORAGE_DEVICE_NAME_AND_TYPE", "RELEVANT_FOLDER", "RADIOLOGY_CONTACT_DATE", "RADIOLOGY_CONTACT_TIME"))),
        T.StructField("INFO_DERIVED_FROM_ORIGINAL_FILE_METADATA", T.MapType(T.StringType(), T.StringType())),
    ]
)
