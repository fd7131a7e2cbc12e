"""Schemas of the scene tables, and the defaults of records that lack a field."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _S, _I, _L, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


POINTS = struct(scan_id=_S, point_id=_L, x=_D, y=_D, z=_D, r=_D, g=_D, b=_D)
DIMENSIONS = struct(length=_D, width=_D, height=_D)
VIEW_VOTE = struct(azimuth=_I, zoom=_B, type=_S, confidence=_D, reason=_S)
PROPERTIES = struct(
    poseZ=_D, coordinateFrame=_S, source=_S, imageFile=_S, imageViews=T.ArrayType(_S), symbolicVerified=_B, symbolicReason=_S,
    viewVotes=T.ArrayType(VIEW_VOTE), voteShare=_D, voteScores=T.MapType(_S, _D), verificationStatus=_S, escalated=_B, isKeyObject=_B,
    isMovable=_B, isOpen=_B, canBeOpen=_B, implicitReason=_S, heightLevel=_S, labelStability=_S, carriedOver=_B, parent=_S, nPoints=_I,
    fill=_D, bottomAboveFloor=_D, n2Pose=T.ArrayType(_D),
)
SEMANTIC_OBJECT = struct(
    type=_S, id=_S, name=_S, poseX=_D, poseY=_D, poseTheta=_D, dimensions=DIMENSIONS, color=_S, confidence=_D, mapId=_S, isInsideOf=_S, properties=PROPERTIES,
)
MESSAGE = struct(headerId=_L, timestamp=_S, version=_S, manufacturer=_S, serialNumber=_S, semanticObjects=T.ArrayType(SEMANTIC_OBJECT), allowedTypes=T.ArrayType(_S))
RELATION = struct(
    subject=_S, predicate=_S, object=_S, z_gap=_D, gap_m=_D, bearing_deg=_D, confidence=_D, note=_S, symmetric=_B, border_cells=_I, doorway=T.ArrayType(_D),
)
POSE = struct(x=_D, y=_D, z=_D, theta=_D)
NODE = struct(
    id=_S, name=_S, type=_S, map_id=_S, pose=POSE, dimensions=DIMENSIONS, color=_S, confidence=_D, status=_S, presence=_S, implicit=T.MapType(_S, _S),
    first_seen=_S, last_seen=_S, ord=_L,
)
EDGE = struct(subj=_S, pred=_S, obj=_S, revision=_I)
HISTORY = struct(node_id=_S, revision=_I, ts=_S, event=_S, field=_S, old_json=_S, new_json=_S)
PLACE = struct(id=_S, name=_S, type=_S, centroid=T.ArrayType(_D), area_m2=_D, bbox=T.ArrayType(_D), polygon=T.ArrayType(struct(x=_D, y=_D)))
# What records may say.
STATUSES = ("verified", "verified_escalated", "verified_majority", "verified_owner", "verified_recovery", "unverified")
PRESENCE = ("present", "absent")
PREDICATES = ("isOn", "isAboveOf", "isNextTo", "isInFrontOf", "isBehindOf", "isInsideOf", "isConnectedTo")
