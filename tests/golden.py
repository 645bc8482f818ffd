"""Expected flags of known annotations.

Flag order: VarsUsedOnce, UseSiteVariance, ImprUseSiteVariance, RestrictedScope,
ClosedLowerBound, ExistInInv, TrivConsistBounds.
"""

FLAGS = [
    ("Int", "1111101"),
    ("Vector{T} where T", "1111101"),
    ("Pair{T, T} where T", "0011101"),
    ("Ref{Pair{T, T} where T}", "0001111"),
    ("Ref{Tuple{Pair{T, T} where T}}", "0001111"),
    ("Tuple{T, Tuple{T, Int}} where T", "0011101"),
    ("Tuple{Ref{T}} where T", "1111101"),
    ("Tuple{T, Ref{T}} where T", "0011101"),
    ("Tuple{Ref{Tuple{T}}} where T", "1011101"),
    ("Vector{Union{T, Int}} where T", "1010101"),
    ("Ref{Ref{T} where T} where T", "0111111"),
    ("Ref{Pair{T, S} where S} where T", "1010111"),
    ("Pair{S, Pair{Int, T} where T<:S} where S", "0010111"),
    ("Tuple{S, Pair{T, S} where T<:S} where S", "0011101"),
    ("Tuple{T} where T>:(Pair{S,S} where S)", "0001101"),
    ("Tuple{Ref{T} where T>:S} where S", "1111001"),
    ("Vector{Vector{Union{T, Int}} where T}", "1000111"),
    ("Vector{Ref{Tuple{T}} where T}", "1001111"),
    ("Ref{T} where T<:(Ref{S} where S)", "1111101"),
    ("Tuple{T} where T<:Ref{Ref{<:Any}}", "1111111"),
    ("Ref{T} where Int<:T<:Any", "1111101"),
    ("Ref{T} where Union{}<:T<:Number", "1111101"),
    ("Ref{T} where Int<:T<:Vector{Int}", "1111100"),
    ("Tuple{S, Ref{T} where Int<:T<:Number} where S", "1111100"),
    ("Tuple{Vararg{Pair{NTuple{N, K}, <:Any} where N}} where K", "1000111"),
    ("Tuple{Type{Union{Quantity{T, D, U}, Level{L, S, Quantity{T, D, U}} where {L, S}}"
     " where {T, U}}} where D", "0000111"),
    # published rows
    ("Array{Tuple{T, Array{T, N} where N, Bool} where T}", "0001111"),
    ("Tuple{Vararg{Union{T, Set{T}, Vector{T}} where T <: Variable}, Any}", "0001111"),
    ("Dict{K, Union{AbstractArray{<:Number}, AbstractArray{Union{Missing, T}} where T <: Number,"
     " DataFrame}}", "1000111"),
    ("(Tuple{Vararg{Pair{NTuple{N, K}, T} where N}} where T) where K", "1000111"),
    ("Tuple{AbstractChar, Set{T}} where Int <: T <: Integer", "1111100"),
    ("Pair{S, Some{T}} where typeassert(T, DataType) <: S <: typeassert(T, DataType)", "1111100"),
    ("Tuple{Type{T}, Any} where Base.CodeUnits{UInt8, String} <: T <: Base.CodeUnits", "1111100"),
    ("(Tuple{Function, F1, F2, Bool, Bool, Bool} where StructuredFunction <: F2 <: Function)"
     " where StructuredFunction <: F1 <: Function", "1111100"),
]

FLAG_COLUMNS = [
    "VarsUsedOnce", "UseSiteVariance", "ImprUseSiteVariance", "RestrictedScope",
    "ClosedLowerBound", "ExistInInv", "TrivConsistBounds",
]
