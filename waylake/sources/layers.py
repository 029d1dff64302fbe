"""The layers of the state's sources, as descriptions for readers.reshape() (2.15)."""

from __future__ import annotations

from waylake.sources.readers import Layer


def _numbered(name: str, last: int) -> tuple[str, ...]:
    return tuple(f"{name}_{k}" for k in range(1, last + 1))


_DEC = "case when DEC_NAME is not null or DEC_TYPE is not null then concat(coalesce(DEC_NAME, ''), ' ', coalesce(DEC_TYPE, '')) end"

# fixed values: ids, types, names, keys and fields of the published sources
LAYERS = {
    layer.id: layer
    for layer in (
        Layer("LOCALITY", "POLYGON", "locality_name", None, ("Shape__Area", "Shape__Length", "gazetted_locality_name", "pfi", "pfi_created", "task_id", "ufi", "ufi_created", "ufi_old", "vicnames_id")),
        Layer("LGA", "POLYGON", "lga_name", None, ("Shape__Area", "Shape__Length", "abs_lga_code", "gazettal_registration", "lga_code", "lga_official_name", "pfi", "pfi_created", "task_id", "ufi", "ufi_created", "ufi_old")),
        Layer("POSTCODE", "POLYGON", "postcode", None, ("Shape__Area", "Shape__Length", "OBJECTID", "pfi", "pfi_created", "postcode", "task_id", "ufi", "ufi_created", "ufi_old"), values={"OBJECTID": "_key"}),
        Layer("SSD", "POLYGON", "ssd_name", None, ("id", "Shape__Area", "Shape__Length", "ssd_code", "ssd_name"), values={"id": "_key"}),
        Layer("SES_REGION", "POLYGON", "SES_REGION", None, ("ID_SESREGI", "SHAPE_AREA", "SHAPE_LEN", "SES_REGION")),
        Layer("MELWAY", "POLYGON", "MAPREF", None, ("MAPREF",)),
        Layer("DTP_REGIONAL_BOUNDARIES", "POLYGON", "REG_NAME", None, ("ABB_NAME", "OBJECTID", "OBJECTID_1", "REG_NAME", "REG_NUM", "Shape_STAr", "Shape_STLe", "Shape__Area", "Shape__Length", "id"), values={"OBJECTID": "_key"}),
        Layer("LGA_CONTACT", "POLYGON", "LGANAME", None, ("ADDRESS", "CODE", "EMAIL", "FAX", "LGASHORTNA", "MELWAYS_OR", "MUNICIPALI", "PCODE", "PHONE", "POSTAL", "POSTAL_SUB", "SHAPE_AREA", "SHAPE_LEN", "SUBURB__TO", "WWW_SITE")),
        Layer("SAFETY_CAMERAS", "POLYGON", "CAMERA_LOC", None, ("AT_INTERSE", "BUFF_DIST", "LATITUDE", "LONGITUDE", "MAP_REF", "SHAPE_AREA", "SHAPE_LEN", "SITE", "SUBURB", "S_POS_X", "S_POS_Y")),
        Layer("TTMC", "POLYGON", "TTMC", None, ("SHAPE_AREA", "SHAPE_LEN")),
        Layer("FEDERAL_ELECTORATE", "POLYGON", "FEDERALCOD", None, ("FEDERALELE", "ID_FEDERAL", "MEMBERNAME", "MEMBERPART", "MEMBERPORT", "OFFICEADDR", "SHAPE_AREA", "SHAPE_LEN")),
        # of the next three every attribute's value is the feature's name
        Layer("STATE_LOWER_HOUSE", "POLYGON", "district", None, ("Shape__Area", "Shape__Length", "district_code", "district_label", "region", "region_code", "region_label", "ufi", "ufi_created"), named_values=True),
        Layer("STATE_UPPER_HOUSE", "POLYGON", "region", None, ("Shape__Area", "Shape__Length", "region", "region_code", "region_label", "ufi", "ufi_created"), named_values=True),
        Layer("VCSD", "POLYGON", "MAPREF", None, ("EDITION", "HG", "MAP", "MAP_TOWN", "SCALE", "VG"), named_values=True),
        Layer("BUS", "MULTILINE", "BUSROUTEID", None, ("BUSROUTEID", "ID_BUSROUT", "SHAPE_LEN", "VICROADSBU")),
        Layer("TRAM", "MULTILINE", "TRAMROUTED", None, ("FK_ROUTE", "ID_TRAMROU", "SHAPE_LEN", "VICROADSTR")),
        Layer("RESPONSIBLE_AUTHORITY", "MULTIPOLYGON", "ABB_NAME", None, ("AREA", "PERIMETER", "RMA", "SHAPE_AREA", "SHAPE_LEN", "SH_NAME", "SH_PARMS")),
        Layer("DECLARED_NETWORK", "LINE", "ROADNAME", "concat(OBJECTID, '_', md5(geometry))", ("FK_ROUTE", "FROMMEASUR", "ID_EVROADN", "NAMETYPE", "ROADSUFFIX", "ROADTYPE", "TOMEASURE", "ROADNUMBER"), values={"ROADNUMBER": "OBJECTID"}),
        Layer(
            "CUSTOM_SEED_FILE", "LINE", "concat(DEC_NAME, ' ', DEC_TYPE)", "concat('_', md5(geometry))",
            ("DEC_NAME", "DEC_TYPE", "RD_NUM", "RD_SECTION", "CLASSN", "ARTERIAL", "PROFILE", "COMPLEX", "RTE_NO", "CWAY", "SERVICE_RD", "RAMP", "CBR", "R_RTE_NO", "R_CWAY", "R_RAMP", "RNDB_EDIT", "SRNS1", "SRNS2", "SRNS3",
             "MEL30_ART", "RMANUM", "RMACLASS", "RAMP_NUM", "RAMP_NAME", "DEC_STATUS", "PREV_RMA", "AUSLINK", "RMC", "MAINT_ORG", "LGA_NAME", "LGA_ABB_NAME", "REGION_NAME", "RESPONSIBLE_REGION_NAME", "declared_road"),
            drop_nulls=True, dedupe_by=("DEC_NAME", "CLASSN"), values={"REGION_NAME": "DTP_REG_NAME", "RESPONSIBLE_REGION_NAME": "DTP_ABB_NAME", "declared_road": _DEC},
        ),
        Layer(
            "VICMAP_TRANSPORT", "LINE", "road_name", "ufi",
            ("road_name", "road_number", "feature_type_code", "class_code", "height_limit", "Shape__Length", "construction_material", "construction_type", "coordinating_auth_code", "create_date_pfi", "create_date_ufi", "deck_area",
             "direction_code", "div_rd", "local_road", "ezi_road_name_label", "feature_quality_id", "from_ufi", "left_locality", "length_m", "load_limit", "load_limit_assess_date", "named_feature_id", "nre_route", "pfi",
             "physical_condition", "responsible_auth_code", "restrictions", "right_locality", *_numbered("road_name", 7), *_numbered("alternative_road", 3), "road_name_use", *_numbered("road_name_use", 7), "road_seal", "road_status",
             "road_suffix", *_numbered("road_suffix", 7), "road_type", *_numbered("road_type", 7), "route_no", "seasonal_close_date", "seasonal_open_date", "structure_name", "superceded_pfi", "task_id", "to_ufi", "ufi", "urban",
             "vehicular_access", "width_m"),
            drop_nulls=True, values={"road_number": "id"},
        ),
    )
}
