"""Fixed table schemas. Missing labels are null, never NaN."""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()


def _s(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SIGNAL = _s(sig_id=T.LongType(), ch=T.IntegerType(), fs=T.IntegerType(), chunk_no=T.IntegerType(),
            t0=T.LongType(), samples=T.ArrayType(T.FloatType()))
RIR = _s(rir_id=T.LongType(), point=T.IntegerType(), ch=T.IntegerType(), src=T.IntegerType(),
         fs=T.IntegerType(), h=T.ArrayType(T.FloatType()), h_dp=T.ArrayType(T.FloatType()))
ANNOTATION = _s(stem=T.StringType(), room_sz=T.ArrayType(_D), mic_pos=T.ArrayType(T.ArrayType(_D)),
                array_pos=T.ArrayType(_D), traj_pts=T.ArrayType(T.ArrayType(_D)), T60=_D, DRR=_D, C50=_D,
                ABS=_D, SNR=_D, fs=T.IntegerType())
ITEM = _s(rec_id=T.LongType(), m1=T.IntegerType(), m2=T.IntegerType(), st_s=_D, en_s=_D, weight=_D)
POSE_TSV = _s(year=T.IntegerType(), month=T.IntegerType(), day=T.IntegerType(), hour=T.IntegerType(),
              minute=T.IntegerType(), second=_D, x=_D, y=_D, z=_D,
              **{f"rotation_{i}{j}": _D for i in (1, 2, 3) for j in (1, 2, 3)})
UTTERANCE = _s(session=T.StringType(), speaker=T.StringType(), st_s=_D, en_s=_D, text=T.StringType())
RESULT = _s(task=T.StringType(), run=T.StringType(), lr=_D, bs=T.IntegerType(), trial=T.IntegerType(),
            val_loss=_D, val_mae=_D, test_loss=_D, test_mae=_D)
EPOCH_METRIC = _s(run=T.StringType(), epoch=T.IntegerType(), val_loss=_D)
PREDICTION = _s(task=T.StringType(), record=T.LongType(), gt=_D, pred=_D)
